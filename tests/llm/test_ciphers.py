import random

import pytest
from pyspark.sql import functions as F

from quern.llm.ciphers import learn_cipher, margins
from quern.llm.encodings import PAGES, Model, find_garbled, restore_documents

GREEK = """το πρόγραμμα ξεκίνησε χωρίς προβλήματα και τελείωσε νωρίς | η μνήμη γέμισε γρήγορα και ο διακομιστής σταμάτησε | τα αρχεία διαβάζονται από τον δίσκο κάθε φορά που ξεκινά η εργασία
η δοκιμή απέτυχε επειδή δεν υπήρχε αρκετός χώρος | οι μετρήσεις δείχνουν ότι η νέα έκδοση είναι ταχύτερη | το σύστημα περιμένει την επόμενη εντολή του χρήστη | κάθε νήμα γράφει τα αποτελέσματα σε δικό του αρχείο
πρέπει να αλλάξουμε τη ρύθμιση πριν από την επόμενη εκτέλεση | ο χρόνος απόκρισης μειώθηκε κατά το ήμισυ | τα παλιά δεδομένα διαγράφονται αυτόματα μετά από έναν μήνα | η βάση ήταν κλειδωμένη για περισσότερο από μία ώρα"""
TURKISH = """program sorunsuz başladı ve erken bitti | bellek hızla doldu ve sunucu durdu | dosyalar iş her başladığında diskten okunuyor | yeterli alan olmadığı için deneme başarısız oldu
ölçümler yeni sürümün daha hızlı olduğunu gösteriyor | sistem kullanıcının bir sonraki komutunu bekliyor | her iş parçacığı sonuçlarını ayrı bir dosyaya yazıyor | bir sonraki çalıştırmadan önce ayarı değiştirmemiz gerekiyor
yanıt süresi yarı yarıya kısaldı | eski veriler bir ay sonra kendiliğinden silinir | veritabanı bir saatten uzun süre kilitli kaldı | ağ bağlantısı kesildiği için işlem yarıda kaldı | değişiklik çoğu çalışmayı yavaşlattı"""
OTHER = """Die Blöcke werden länger gehalten, weil größere Läufe übrig sind | Le système a été redémarré à zéro, l’étape dépassée n’était pas prête | La función está más lenta después del último período
Błąd wystąpił częściej, choć obciążenie było mniejsze | Работа блоков завершается ошибкой раньше, чем ожидалось | naïve façade, Ångström, Øresund, æther, smørrebrød"""


def sentences(text):
    return [x.strip() for line in text.splitlines() for x in line.split("|")]


def made(seed, page):
    """Documents in which those of source ``g`` were written in ``page`` and read as cp1252."""
    r = random.Random(seed)
    tongue = sentences(GREEK if page == "cp1253" else TURKISH)
    words = [w for x in tongue for w in x.split()]

    def text(own):
        return ". ".join(r.choice(own) if r.random() < 0.5 else " ".join(r.choice(words if own is tongue else r.choice(own).split()) for _ in range(7)) for _ in range(5))

    rows, truth = [], {}
    for i in range(900):
        rows.append((i, text(tongue if i % 3 == 0 else sentences(OTHER)), r.choice("abg")))
    for i in range(1000, 1040):
        clean = text(tongue)
        truth[i] = clean
        rows.append((i, "".join(bytes([b]).decode("cp1252") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in clean.encode(page, "replace")), "g"))
    return rows, truth


@pytest.mark.parametrize("page", ["cp1253", "cp1254"])
def test_a_swap_of_no_listed_page_is_learned_found_and_restored(spark, page):
    assert page not in PAGES
    rows, truth = made(3, page)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    found, model = find_garbled(df)
    got = {r["doc_id"]: r["swap"] for r in found.collect()}
    assert len(set(truth) & set(got)) >= 0.9 * len(truth) and not set(got) - set(truth)
    restored = {r["doc_id"]: r["restored"] for r in restore_documents(df, "doc_id", "text", F.col("source"), model).collect()}

    def right(told):
        pairs = [(x, y) for i, t in truth.items() for x, y in zip(t, told.get(i, "")) if x > "\x7f"]
        return sum(x == y for x, y in pairs) / sum(x > "\x7f" for t in truth.values() for x in t)

    assert right(restored) >= 0.97
    # without the learned mapping they can't be restored
    bare = Model(model.bigrams, model.sources.withColumns({"_symbols": F.lit(None).cast("string"), "_letters": F.lit(None).cast("string")}))
    assert right({r["doc_id"]: r["restored"] for r in restore_documents(df, "doc_id", "text", F.col("source"), bare).collect()}) < 0.5


def test_rare_letters_of_one_source_are_no_cipher():
    r = random.Random(1)

    def count(texts):
        out = {}
        for t in texts:
            for pair in zip(t, t[1:]):
                out[pair] = out.get(pair, 0.0) + 1
        return out

    danish = ["blå grød på øen", "æblerne lå på gården", "søen er rød og blå", "hun går på vejen ærligt"]
    clean = [r.choice(sentences(OTHER) + sentences(TURKISH)) for _ in range(400)]
    own = count([r.choice(danish) for _ in range(100)])
    whole = count(clean)
    for p, n in own.items():
        whole[p] = whole.get(p, 0.0) + n
    page = [bytes([b]).decode("latin-1") for b in range(256)]
    bytes_ = {c: b for b, c in enumerate(page) if b >= 160}
    assert learn_cipher(own, whole, margins(whole), [bytes_], [{b: c for c, b in bytes_.items()}]) == {}
    assert learn_cipher({}, {}, margins({}), [bytes_], []) == {}
