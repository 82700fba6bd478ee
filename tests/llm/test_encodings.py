import random

import pytest
from pyspark.sql import functions as F

from quern.llm.encodings import Pages, find_garbled, resolved, restore_documents, runs

SENTENCES = [
    "Die Blöcke werden länger gehalten, weil größere Läufe für den Zähler übrig sind.", "Le système a été redémarré à zéro, l’étape dépassée n’était pas prête.",
    "La función está más lenta después del último período; ¿por qué?", "A configuração não é suficiente para essa operação média.", "Błąd wystąpił częściej, choć obciążenie było mniejsze.",
    "Работа блоков завершается ошибкой раньше, чем ожидалось.", "キャッシュが上限を超えると、古いブロックから追い出される。", "The sweep took 12.5 µs ± 3 µs for 6k × 6k – that’s “fine”.", "Fan Ø 20 mm, cable ¾ inch, Ångström, naïve façade, √n, n → ∞, § 4.",
    "├── run.out │ ╔══╗ ✅ 🚀 👍🏽 n² ≥ 4 °C", "plain ascii only, nothing else",
]
SWAPS = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("cp1252", "cp437"), ("cp1252", "latin-1"), ("koi8_r", "cp1251"), ("cp1251", "cp1252")]


def spoil(text, right, wrong):
    raw = text.encode(right, "strict")
    return "".join(bytes([b]).decode(wrong) if _fits(b, wrong) else chr(b) for b in raw)


def _fits(b, page):
    try:
        bytes([b]).decode(page)
        return True
    except UnicodeDecodeError:
        return False


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(4)
    rows, truth = [], {}
    for i in range(1500):
        clean = " ".join(r.choice(SENTENCES) for _ in range(4))
        text = clean
        if r.random() < 0.08:
            right, wrong = r.choice(SWAPS)
            try:
                part = r.choice(SENTENCES[:8])
                bad = spoil(part, right, wrong)
                if bad != part:
                    text, truth[i] = f"{clean}\n{bad}", f"{clean}\n{part}"
            except UnicodeEncodeError:
                pass
        rows.append((i, text, r.choice(["a", "b", None]), "clash"))
    rows += [(2000, None, "a", ""), (2001, "", "a", ""), (2002, "   ", None, ""), (2003, "x" * 100_000, "a", ""), (2004, "lost B�cke", "a", ""), (2005, SENTENCES[0] + " &Atilde;&curren;ndern l&Atilde;&curren;nger", "b", "")]
    return rows, truth | {2004: None, 2005: None}


def test_garbled_documents_are_found_and_restored(spark, corpus):
    rows, truth = corpus
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, swap string").repartition(4)
    found, model = find_garbled(df)
    got = {r["doc_id"] for r in found.collect()}
    missed, extra = set(truth) - got, got - set(truth)
    assert len(missed) <= 0.03 * len(truth), [dict((r[0], r[1]) for r in rows)[i][-90:] for i in missed]
    assert not extra
    restored = {r["doc_id"]: r for r in restore_documents(df, "doc_id", "text", F.col("source"), model).collect()}
    assert set(restored) == got
    whole = [i for i in got if truth[i]]
    assert sum(restored[i]["restored"] == truth[i] for i in whole) >= 0.95 * len(whole)
    assert restored[2004]["n_lost"] == 1 and "�" in restored[2004]["restored"]


def test_empty_table(spark):
    found, _ = find_garbled(spark.createDataFrame([], "doc_id long, text string, source string"))
    assert found.count() == 0


def test_layers_are_peeled():
    pages = Pages()
    for text in ("µ", "größer", "’", "×", "速い"):
        twice = spoil(spoil(text, "utf-8", "cp1252"), "utf-8", "cp1252")
        assert any(t == text for _, t in pages.wide_candidates(twice)), twice
    japanese = spoil("ブロックから追い出される", "cp932", "cp1252")
    assert any(t == "ブロックから追い出される" for _, t in pages.wide_candidates(japanese))
    assert pages.wide_candidates("é") == [] and pages.wide_candidates("Größe"[2:4]) == []


def test_references_and_runs():
    assert resolved("&Atilde;&curren; &amp; &lt; &nosuch; 5 & 6") == "Ã¤ &amp; &lt; &nosuch; 5 & 6"
    assert [("aéb ↔ü"[a:b]) for a, b in runs("aéb ↔ü")] == ["é", "↔ü"] and runs("") == []


def test_japanese_is_found_behind_all_pages(spark):
    first, second = "キャッシュが上限を超えると、古いブロックから追い出される。", "実行のたびにメモリの使用量をログに記録してください。"
    pages, r = Pages(), random.Random(6)
    capitals = "ГОСТ ВАГОН ГРУППА ВРЕМЯ БЛОК Вера Гора Втроём БАЗА ГАЗ ВЫВОД ГИБДД СССР ВВОД"
    rows = [(i, " ".join(r.choice([*SENTENCES, capitals]) for _ in range(4)), "a", "") for i in range(600)]
    truth = {}
    for right in ("cp932", "euc_jp"):
        for wrong in ("cp1251", "koi8_r", "cp866", "iso8859_2", "iso8859_5", "iso8859_15", "mac_cyrillic", "mac_latin2", "cp1252"):
            for text in (first, second):
                bad = spoil(text, right, wrong)
                whole = [bad[a:b] for a, b in runs(bad)]
                assert any("の" in t or "ブロック" in t for u in whole for _, t in pages.wide_candidates(u)), (right, wrong)
                truth[1000 + len(truth)] = text
                rows.append((999 + len(truth), f"the log says {bad}", "a", ""))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, swap string").repartition(4)
    found, model = find_garbled(df)
    assert {r["doc_id"] for r in found.collect()} == set(truth)
    restored = {r["doc_id"]: r["restored"] for r in restore_documents(df, "doc_id", "text", F.col("source"), model).collect()}
    assert sum(restored[i] == f"the log says {t}" for i, t in truth.items()) >= 0.9 * len(truth)
