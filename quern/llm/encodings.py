"""Text that was decoded with a wrong character encoding: which documents hold such passages, and what stood there.

A wrong decoding is a substitution cipher whose code page swap is unknown: read as page W, bytes written in page R. Each document has one unknown swap or none,
each run of non-ASCII characters in it was spoiled by that swap or not, and clean text follows letter bigrams. Expectation-maximization learns all of it from the corpus:

* E step: a document's odds for each swap, from the bigram odds of the deciphered against the given runs and the swap's weight in the document's source;
* M step: bigrams of what is clean, the weight of each swap in each source, and, from the neighbours that no listed swap explains, each source's own mapping of symbols to
  letters (``quern.llm.ciphers``).

Swaps of the ``PAGES`` start as listed mappings; a source's learned mapping is one more swap, which needs no page and is applied by ``str.translate`` like those. An exact check
keeps what goes back to the given text without loss. Several bytes for one letter (UTF-8 and the Japanese pages) make ciphers of groups, which are split by their page;
texts wrongly decoded several times are peeled in turns. Character references (``&Atilde;``) are resolved first. U+FFFD marks bytes that are lost for good.

What is known of a source (weights, mapping) stays in a table that is joined to its documents; only the bigrams, which the alphabet bounds, come to the driver.
"""

from __future__ import annotations

import html
import json
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.ciphers import learn_cipher, margins
from quern.plans.materialize import broadcast_if_small, materialize

#: Pages that text is taken to be written or read in.
PAGES = "cp1252 latin_1 mac_roman cp437 cp850 cp852 cp1250 iso8859_2 iso8859_15 cp1251 koi8_r cp866 iso8859_5 mac_cyrillic mac_latin2".split()
WIDE = ["utf_8", "cp932", "euc_jp"]
STEPS = 4
#: Shares of a document's runs that a swap may have spoiled, all held likely alike.
SHARES = (0.02, 0.3, 0.95)
#: A swap's weight in a source is learned, but not below this; a document is a case if its best swap has at least these odds.
LEAST_WEIGHT, ODDS = 0.02, 0.3
SMOOTH = 2.0
#: Clean runs are seldom well-formed in a page of several bytes a letter by accident: log odds for such a page beside those of the bigrams.
WIDE_ODDS = math.log(10)
#: Log odds by single characters under which a single-byte swap isn't tried.
UNLIKELY = -5.0
#: How many letters a class of the bigram model stands for. Letters of a class are all one symbol there, which makes them too likely beside other scripts.
CLASS_SIZES = {"あ": 83, "ア": 86, "漢": 3000, "、": 60, "！": 90, "가": 2000, "֐": 5000, "㐀": 500, "\U0001f680": 1000}
LOST = "�"
KNOWN_RUNS = 200_000

RUN = re.compile(r"[^\x00-\x7f]+")
#: Japanese pages use ASCII bytes inside letters: runs may hold single ASCII characters and end with one.
MIXED_RUN = re.compile(r"[^\x00-\x7f](?:[@-~]{0,2}[^\x00-\x7f])+[@-~]?")
#: Lost characters and control characters are no letters of clean text.
NOT_CLEAN = re.compile(f"[\x80-\x9f{LOST}]")
REFERENCE = re.compile(r"&[A-Za-z][A-Za-z0-9]*;")


class Pages:
    """Byte and letter tables. Bytes that a page leaves free are read as the control characters of their number, as common decoders do."""

    def __init__(self) -> None:
        self.letters: list[list[str]] = []
        #: bytes of a page's own letters, and with all control characters, which turn up inside layers of different pages
        self.own_byte: list[dict[str, int]] = []
        self.byte: list[dict[str, int]] = []
        for page in PAGES:
            row = []
            for b in range(256):
                try:
                    row.append(bytes([b]).decode(page))
                except UnicodeDecodeError:
                    row.append(chr(b))
            self.letters.append(row)
            own = {c: b for b, c in enumerate(row) if b >= 128}
            self.own_byte.append(own)
            self.byte.append({chr(b): b for b in range(128, 160)} | own)
        #: groups of a page's characters that may be one letter of UTF-8
        self.groups = []
        for back in self.byte:
            of = lambda low, high: "[" + re.escape("".join(c for c, b in back.items() if low <= b < high)) + "]"  # noqa: B023, E731
            more = of(0x80, 0xC0)
            self.groups.append(re.compile(f"{of(0xC2, 0xE0)}{more}|{of(0xE0, 0xF0)}{more}{{2}}|{of(0xF0, 0xF5)}{more}{{3}}"))
        n = len(PAGES)
        self.single = [(w, r) for w in range(n) for r in range(n) if w != r]
        #: for each single-byte swap the table of str.translate
        self.tables = []
        for w, r in self.single:
            table = {ord(c): self.letters[r][b] for c, b in self.own_byte[w].items()}
            self.tables.append(table)
        #: what the bytes before most kana of cp932 are read as
        self.leads = {row[b] for row in self.letters for b in (0x81, 0x82, 0x83)}
        #: for each character the pages that have it, and the swaps that change it into a printable character, as bits
        self.pages_with: Counter[str] = Counter()
        self.swaps_of: dict[str, int] = {}
        for w in range(n):
            for c in self.byte[w]:
                self.pages_with[c] |= 1 << w
        for k, table in enumerate(self.tables):
            for c, x in table.items():
                if x.isprintable() or x == "\xa0":
                    self.swaps_of[chr(c)] = self.swaps_of.get(chr(c), 0) | 1 << k

    def name(self, k: int) -> str:
        if k < len(self.single):
            w, r = self.single[k]
            return f"{PAGES[r]} as {PAGES[w]}"
        if k == self.learned:
            return "learned"
        k -= len(self.single)
        return f"{WIDE[k // len(PAGES)]} as {PAGES[k % len(PAGES)]}"

    def mixed(self, run: str) -> bool:
        """Whether a run with ASCII characters inside may be cp932 that was read as one of the pages."""
        if sum(c in self.leads for c in run) * 5 < len(run):
            return False
        for w in range(len(PAGES)):
            raw = self.encode(run, w)
            try:
                if raw is not None and kana(raw.decode("cp932")):
                    return True
            except UnicodeDecodeError:
                continue
        return False

    def encode(self, run: str, w: int) -> bytes | None:
        byte = self.byte[w]
        try:
            return bytes([byte[c] if c >= "\x80" else ord(c) for c in run])
        except KeyError:
            return None

    def layer(self, run: str, w: int, partly: bool) -> str | None:
        """``run`` without one layer of UTF-8 read as page ``w``; None if it has none. ``partly``: other characters may stand beside it."""
        raw = self.encode(run, w)
        if raw is not None:
            try:
                return raw.decode("utf-8")
            except UnicodeDecodeError:
                pass
        if not partly:
            return None

        def letter(m: re.Match[str]) -> str:
            try:
                return self.encode(m.group(), w).decode("utf-8")
            except UnicodeDecodeError:
                return m.group()

        text = self.groups[w].sub(letter, run)
        return None if text == run else text

    def peel(self, run: str, w: int, partly: bool = False) -> str | None:
        """``run`` without all its layers, the outer one read as page ``w``, inner ones as the first page or ``w``; None if there is none."""
        text = self.layer(run, w, partly)
        while text is not None and len(text) > 1:  # each layer is shorter than the one around it
            inner = next((x for v in dict.fromkeys((0, w)) if (x := RUN.sub(lambda m: self.layer(m.group(), v, partly) or m.group(), text)) != text), None)  # noqa: B023
            if inner is None:
                break
            text = inner
        return text

    @property
    def learned(self) -> int:
        """The number of the swap that stands for a source's learned mapping."""
        return len(self.single) + len(WIDE) * len(PAGES)

    def wide_candidates(self, run: str, right: str = "", partly: bool = True) -> list[tuple[int, str]]:
        """Pages of several bytes a letter that may have been read as single bytes to make ``run``, with what it was."""
        out = []
        pages = -1
        for c in set(run):
            pages &= self.pages_with[c] if c >= "\x80" else -1
        base, n = len(self.single), len(PAGES)
        for w in range(n) if pages else ():
            if not pages >> w & 1:
                continue
            if len(run) > 1:
                text = self.peel(run, w)
                if text is not None and text != run:
                    out.append((base + w, text))
            if w == 0 and right == " " and run[-1] in "ÃÂ":  # a no-break space that was made a blank
                text = self.peel(run + "\xa0", w, partly)
                if text is not None:
                    out.append((base + w, text))
            if len(run) > 1:
                raw = self.encode(run, w)
                for j in (1, 2):
                    try:
                        text = raw.decode(WIDE[j])
                    except UnicodeDecodeError:
                        continue
                    if kana(text):
                        out.append((base + j * n + w, text))
        if partly and not out and len(run) > 1:
            for w in range(n):
                text = self.peel(run, w, True)
                if text is not None and text != run:
                    out.append((base + w, text))
        return out


def kana(text: str) -> bool:
    """Whether ``text`` has as many kana as Japanese has at least."""
    return sum("\u3040" <= c < "\u30ff" for c in text) * 5 >= len(text)


def plain_word(text: str) -> bool:
    """Whether ``text`` is written like a word of a small alphabet other than Latin: letters only, and capitals only at its start or throughout."""
    return len(text) > 2 and all("\u0370" <= c < "\u0600" for c in text) and text.isalpha() and (text[1:].islower() or text.isupper())


@cache
def shared_pages() -> Pages:
    return Pages()


def symbol(c: str) -> str:
    """The letter of the bigram model that stands for a character: digits, blanks and the large scripts are classes, so the alphabet is bounded (some 3,400 symbols)."""
    o = ord(c)
    if o < 128:
        return "0" if c.isdigit() else " " if c.isspace() or o < 32 else c
    if o < 0x2E80:
        if o < 0x0700 or 0x0E00 <= o < 0x0E80 or 0x1E00 <= o < 0x2000:
            return c
        return "֐" if o < 0x1E00 else c if o < 0x2300 or 0x2500 <= o < 0x2600 else chr(o & ~0x7F)
    if o < 0x3040:
        return "、"
    if o < 0x30A0:
        return "あ"
    if o < 0x3100:
        return "ア"
    if 0x3400 <= o < 0xA000:
        return "漢"
    if 0xAC00 <= o < 0xD7A4:
        return "가"
    if 0xE000 <= o < 0xF900:
        return ""
    if 0xFF00 <= o < 0xFFEF and o != 0xFEFF:
        return "あ" if 0xFF66 <= o < 0xFFA0 else "！"
    return "\U0001f680" if o >= 0x1F000 else "㐀" if o < 0x3400 else LOST if c == LOST else "️"


class Bigrams:
    """Smoothed probabilities of a letter after another, from (expected) counts."""

    def __init__(self, counts: dict[tuple[str, str], float]):
        self.pair = counts
        self.first: dict[str, float] = {}
        single: dict[str, float] = {}
        for (a, b), n in counts.items():
            self.first[a] = self.first.get(a, 0.0) + n
            single[b] = single.get(b, 0.0) + n
        total, kinds = sum(single.values()), len(single) + 1000
        self.rare = 0.02 / (total + 0.02 * kinds)
        self.single = {b: (n + 0.02) / (total + 0.02 * kinds) for b, n in single.items()}

    def score(self, text: str) -> float:
        out, a = 0.0, text[0]
        for b in text[1:]:
            out += math.log((self.pair.get((a, b), 0.0) + SMOOTH * self.single.get(b, self.rare)) / (self.first.get(a, 0.0) + SMOOTH))
            a = b
        return out


def symbols(text: str) -> str:
    return "".join(map(symbol, text))


def resolved(text: str) -> str:
    """``text`` with named references to non-ASCII characters resolved."""
    if "&" not in text:
        return text
    return REFERENCE.sub(lambda m: u if (u := html.unescape(m.group()))[0] > "\x7f" else m.group(), text)


def runs(text: str) -> list[tuple[int, int]]:
    """Where the runs of a (resolved) text stand. Runs with single ASCII characters inside are taken where they may be of a Japanese page."""
    out = []
    plain = [m.span() for m in RUN.finditer(text)]
    if plain and not shared_pages().leads.isdisjoint(text):
        for m in MIXED_RUN.finditer(text):
            run = m.group()
            if len(run) > 2 and any(c < "\x80" for c in run) and shared_pages().mixed(run):
                out.append(m.span())
    if not out:
        return plain
    ends = iter([*out, (len(text) + 1, len(text) + 2)])
    a, b = next(ends)
    for s, e in plain:
        while s >= b:
            a, b = next(ends)
        if s < a:
            out.append((s, e))
    return sorted(out)


class Known:
    """What is known of a source: the weights of swaps, and the learned mapping."""

    def __init__(self, weights: dict[int, float], mapping: dict[str, str]):
        self.weights, self.mapping = weights, mapping
        self.table = {ord(c): x for c, x in mapping.items()}
        self.back = {x: c for c, x in mapping.items()}


NOTHING = Known({}, {})


class Judge:
    """The E step for one document: scores of its runs under the present model."""

    def __init__(self, pages: Pages, bigrams: Bigrams):
        self.pages, self.bigrams = pages, bigrams
        self.known: dict[str, dict[int, tuple[float, str]]] = {}
        self.gains: dict[str, np.ndarray] = {}

    def gain_of(self, c: str) -> np.ndarray:
        """For each single-byte swap, how much more frequent the deciphered character is than ``c`` (log)."""
        had = self.gains.get(c)
        if had is None:
            had = np.full(len(self.pages.single), -1e9)
            swaps, o = self.pages.swaps_of.get(c, 0), ord(c)
            own = math.log(self.bigrams.single.get(symbol(c), self.bigrams.rare))
            for k, table in enumerate(self.pages.tables):
                if swaps >> k & 1:
                    had[k] = math.log(self.bigrams.single.get(symbol(table[o]), self.bigrams.rare)) - own
            self.gains[c] = had
        return had

    def odds(self, unit: str) -> dict[int, tuple[float, str]]:
        """For each swap under which the deciphered run is likelier than the given one: log odds, and the deciphered run."""
        had = self.known.get(unit)
        if had is None:
            had = {}
            left, run, right = unit[0], unit[1:-1], unit[-1]
            found = self.pages.wide_candidates(run, right)
            gain = self.gain_of(run[0])
            for c in run[1:]:
                gain = gain + self.gain_of(c)
            # most swaps make rare characters of frequent ones, whatever stands beside them
            found += [(k, run.translate(self.pages.tables[k])) for k in np.flatnonzero(gain > UNLIKELY).tolist()]
            if found:
                own, wide = self.bigrams.score(left + symbols(run) + right), len(self.pages.single)
                scores: dict[str, float] = {}
                for k, text in found:
                    x = scores.get(text)
                    if x is None:
                        x = scores[text] = self.bigrams.score(left + symbols(text) + right) - own
                    odds = x + WIDE_ODDS if k >= wide else x
                    if k >= wide:
                        odds -= sum(math.log(CLASS_SIZES.get(c, 1)) for c in symbols(text)) - sum(math.log(CLASS_SIZES.get(c, 1)) for c in symbols(run))
                    if odds > had.get(k, (0.0,))[0]:
                        had[k] = (odds, text)
            if len(self.known) >= KNOWN_RUNS:
                self.known.clear()
            self.known[unit] = had
        return had

    def learned_odds(self, known: Known, unit: str) -> tuple[float, str] | None:
        text = unit[1:-1].translate(known.table)
        if text == unit[1:-1]:
            return None
        gain = self.bigrams.score(unit[0] + symbols(text) + unit[-1]) - self.bigrams.score(unit[0] + symbols(unit[1:-1]) + unit[-1])
        return (gain, text) if gain > 0 else None

    def document(self, known: Known, units: list[str]) -> tuple[float, int, float, list[dict[int, tuple[float, str]]]]:
        """Log odds of the best swap, the swap (-1: none fits), the share of runs it spoiled, and the odds of each run."""
        per_run = [self.odds(u) for u in units]
        if known.table:
            more = [self.learned_odds(known, u) for u in units]
            per_run = [found | {self.pages.learned: x} if x else found for found, x in zip(per_run, more)]
        sums: dict[int, list[float]] = {}
        for found in per_run:
            for k, (x, _) in found.items():
                gain = math.exp(min(x, 30.0))
                row = sums.setdefault(k, [0.0] * len(SHARES))
                for i, share in enumerate(SHARES):
                    row[i] += math.log(1 - share + share * gain) - math.log(1 - share)
        best, swap, part = -math.inf, -1, SHARES[0]
        for k, row in sums.items():
            each = [g + len(units) * math.log(1 - share) for g, share in zip(row, SHARES)]
            top = max(each)
            value = top + math.log(sum(math.exp(e - top) for e in each) / len(SHARES)) + math.log(max(known.weights.get(k, 0.0), LEAST_WEIGHT))
            if value > best:
                best, swap, part = value, k, SHARES[each.index(top)]
        return best, swap, part, per_run


def _units(text: str) -> list[str]:
    return [(symbol(text[a - 1]) if a else " ") + text[a:b] + (symbol(text[b]) if b < len(text) else " ") for a, b in runs(text)]


#: A run with the letter before it and the one after it.
RUNS_SCHEMA = "`_id` bigint, `_source` string, `_runs` array<string>"


def document_runs(documents: DataFrame, key: str, text: str, source: Column) -> DataFrame:
    """The runs of each document that has any, with the letters beside them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sources, out = [], [], []
            for i, s, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if t.isascii() and "&" not in t:
                    continue
                units = _units(resolved(t))
                if units:
                    ids.append(i), sources.append(s)
                    out.append(units)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sources, pa.string()), pa.array(out, pa.list_(pa.string()))], names=["_id", "_source", "_runs"])

    return documents.select(F.col(key).cast("long"), F.coalesce(source, F.lit("")), F.col(text)).filter(F.col(text).isNotNull()).mapInArrow(run, RUNS_SCHEMA)


#: What is known of a source: swaps and their weights, symbols and their letters. Its documents carry it as one text.
KNOWN = "`_swaps` array<int>, `_weights` array<double>, `_symbols` string, `_letters` string"


def _known(told: str | None) -> Known:
    said = json.loads(told) if told else {}
    return Known(dict(zip(said.get("_swaps", ()), said.get("_weights", ()))), dict(zip(said.get("_symbols", ""), said.get("_letters", ""))))


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[int, str, list[str], Known]]:
    """Documents with what is known of their sources; columns ``_id, _source, _runs`` (or another) and ``_known``."""
    seen: dict[str | None, Known] = {}
    for i, source, units, told in zip(*(batch.column(c).to_pylist() for c in range(4))):
        known = seen.get(told)
        if known is None:
            known = seen[told] = _known(told)
        yield i, source, units, known


STATS_SCHEMA = "`kind` string, `a` string, `b` string, `n` double"
#: Counts a task holds before it hands them on; they are added up afterwards, so this bounds memory only.
HELD_COUNTS = 500_000


class Model:
    """What the iterations learned: bigrams, and a table of the sources (``_source`` and the columns of ``KNOWN``)."""

    def __init__(self, bigrams: dict[tuple[str, str], float], sources: DataFrame):
        self.bigrams, self.sources = bigrams, sources

    def told(self, df: DataFrame) -> DataFrame:
        """``df`` with ``_known``, what is known of each row's ``_source``."""
        right = broadcast_if_small(self.sources, MAX_BROADCAST_SOURCES)
        right = right.select(F.col("_source").alias("_named"), F.to_json(F.struct("_swaps", "_weights", "_symbols", "_letters")).alias("_known"))
        return df.join(right, F.col("_source") == F.col("_named"), "left").drop("_named")


MAX_BROADCAST_SOURCES = 20_000


def _no_sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], f"`_source` string, {KNOWN}")


def _pass(found_runs: DataFrame, model: Model | None, own: bool = False, without: bool = False) -> tuple[DataFrame, dict[tuple[str, str], float]]:
    """One pass that sums expected counts: the table of sums, and the bigrams. ``own``: those of each source besides. ``without``: what learned mappings would change says nothing of clean text."""
    spark = found_runs.sparkSession
    sent = spark.sparkContext.broadcast(model.bigrams if model else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pages = shared_pages()
        judge = Judge(pages, Bigrams(sent.value)) if sent.value is not None else None
        counts: Counter[tuple[str, str, str]] = Counter()
        kept: dict[str, bool] = {}
        #: how often each run stands in clean text (of a source, where those are wanted); its bigrams are counted once for all
        clean_units: dict[tuple[str, str], float] = {}

        def count_bigrams() -> None:
            for (source, unit), n in clean_units.items():
                row = unit[0] + symbols(unit[1:-1]) + unit[-1]
                for a, b in zip(row, row[1:]):
                    counts["pair", a, b] += n
                    if own:
                        counts["own", source, a + b] += n
            clean_units.clear()

        def told() -> pa.RecordBatch:
            table = [(kind, a, b, n) for (kind, a, b), n in counts.items()]
            counts.clear()
            columns = list(zip(*table)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string()] * 3 + [pa.float64()])], names=["kind", "a", "b", "n"])

        for batch in batches:
            for _, source, units, known in _rows(batch):
                counts["swap", source, "-2"] += 1
                chance, swap, share, per_run = 0.0, -1, 0.0, []
                if judge:
                    value, swap, share, per_run = judge.document(known, units)
                    chance = 1 / (1 + math.exp(-max(min(value, 30.0), -30.0)))
                    counts["swap", source, str(swap)] += chance
                for j, unit in enumerate(units):
                    clean = 1.0
                    if judge is None:  # to begin with, whatever could be a wide page read as single bytes says nothing of clean text
                        if unit not in kept:
                            if len(kept) >= KNOWN_RUNS:
                                kept.clear()
                            kept[unit] = plain_word(unit[1:-1]) or not pages.wide_candidates(unit[1:-1], unit[-1], partly=False)
                        clean = float(kept[unit])
                    elif without and known.table and unit[1:-1].translate(known.table) != unit[1:-1]:
                        clean = 0.0
                    elif swap in per_run[j]:
                        gain = share * math.exp(min(per_run[j][swap][0], 30.0))
                        clean = 1 - chance * gain / (gain + 1 - share)
                    if clean > 0.01 and not NOT_CLEAN.search(unit):
                        place = source if own else "", unit
                        clean_units[place] = clean_units.get(place, 0.0) + clean
            if len(clean_units) >= KNOWN_RUNS:
                count_bigrams()
            if len(counts) >= HELD_COUNTS:
                yield told()
        count_bigrams()
        yield told()

    rows = (model or Model({}, _no_sources(spark))).told(found_runs).select("_id", "_source", "_runs", "_known")
    sums = materialize(rows.mapInArrow(run, STATS_SCHEMA).groupBy("kind", "a", "b").agg(F.sum("n").alias("n")), "expected-counts")
    bigrams = {(r["a"], r["b"]): r["n"] for r in sums.filter("kind = 'pair'").collect()}  # the alphabet bounds them
    return sums, bigrams


def _weights(sums: DataFrame) -> DataFrame:
    """``_source``, ``_swaps``, ``_weights``: the part of the source's documents that each swap spoiled."""
    swaps = sums.filter("kind = 'swap'").select(F.col("a").alias("_source"), F.col("b").cast("int").alias("k"), "n")
    whole = swaps.groupBy("_source").agg(F.sum(F.when(F.col("k") == -2, F.col("n"))).alias("all"), F.collect_list(F.when(F.col("k") >= 0, F.struct("k", "n"))).alias("s"))
    return whole.select("_source", F.transform("s", lambda x: x["k"]).alias("_swaps"), F.transform("s", lambda x: x["n"] / F.col("all")).alias("_weights"))


def _mappings(sums: DataFrame, bigrams: dict[tuple[str, str], float]) -> DataFrame:
    """``_source``, ``_symbols``, ``_letters`` of the sources that show a cipher. A source's pairs, not its rows, are one group, and the alphabet bounds them."""
    sent = sums.sparkSession.sparkContext.broadcast((bigrams, margins(bigrams)))

    def fit(table: pa.Table) -> pa.Table:
        pages = shared_pages()
        pairs = {(b[0], b[1]): n for b, n in zip(table.column("b").to_pylist(), table.column("n").to_pylist())}
        letters = [{c: b for c, b in own.items() if c.isprintable()} for own in pages.own_byte]
        rows = [{b: c for b, c in enumerate(row) if b >= 128} for row in pages.letters]
        mapping = learn_cipher(pairs, *sent.value, letters, rows)
        names = ["_source", "_symbols", "_letters"]
        return pa.table([pa.array(x, pa.string()) for x in ([table.column("a")[0].as_py()], ["".join(mapping)], ["".join(mapping.values())])], names=names)

    own = sums.filter("kind = 'own'").select("a", "b", "n").groupBy("a").applyInArrow(fit, "`_source` string, `_symbols` string, `_letters` string")
    return materialize(own.filter("_symbols != ''"), "mappings")


def _sources(sums: DataFrame, mappings: DataFrame | None) -> DataFrame:
    both = _weights(sums)
    none = F.lit(None).cast("string")
    both = both.withColumns({"_symbols": none, "_letters": none}) if mappings is None else both.join(mappings, "_source", "left")
    return materialize(both.select("_source", "_swaps", "_weights", "_symbols", "_letters"), "sources")


def learn(found_runs: DataFrame, steps: int = STEPS) -> Model:
    """Expectation-maximization over all runs of all documents. Where a source shows a cipher that no listed swap explains, its mapping takes part in two further steps."""
    model: Model | None = None
    for step in range(steps):
        sums, bigrams = _pass(found_runs, model, own=step == steps - 1)
        model = Model(bigrams, _sources(sums, None))
    mappings = _mappings(sums, bigrams)
    if mappings.isEmpty():
        return model
    model = Model(bigrams, _sources(sums, mappings))
    for without in (True, False):
        sums, bigrams = _pass(found_runs, model, without=without)
        model = Model(bigrams, _sources(sums, mappings))
    return model


def _exact(pages: Pages, known: Known, swap: int, run: str, text: str) -> bool:
    """Whether ``text``, written as its page and read as the wrong one, gives ``run`` again. Peeled layers are checked by the decoders themselves."""
    if swap == pages.learned:
        return all(known.back.get(x, x) == c for c, x in zip(run, text))
    if swap >= len(pages.single):
        return True
    w, r = pages.single[swap]
    raw = [pages.own_byte[r].get(c, ord(c)) for c in text]
    return all(b < 256 for b in raw) and "".join(pages.letters[w][b] for b in raw) == run


def _verdict(judge: Judge, known: Known, units: list[str]) -> tuple[float, int, list[str | None]] | None:
    """The odds, swap and restored runs (None: as it stands) of a document with a spoiled passage; None for others."""
    lost = any(LOST in u for u in units)
    value, swap, share, per_run = judge.document(known, units)
    fixed: list[str | None] = [None] * len(units)
    if value >= math.log(ODDS):
        for j, found in enumerate(per_run):
            if swap in found and share * math.exp(min(found[swap][0], 30.0)) > (1 - share) and _exact(judge.pages, known, swap, units[j][1:-1], found[swap][1]):
                fixed[j] = found[swap][1]
    if lost or any(f is not None for f in fixed):
        return value, swap if any(f is not None for f in fixed) else -1, fixed
    return None


def garbled_documents(found_runs: DataFrame, model: Model) -> DataFrame:
    """``_id``, ``_source``, ``swap`` (null if only lost characters tell), ``log_odds``, ``n_restorable`` runs and ``n_lost`` characters."""
    sent = found_runs.sparkSession.sparkContext.broadcast(model.bigrams)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(shared_pages(), Bigrams(sent.value))
        for batch in batches:
            out = []
            for i, source, units, known in _rows(batch):
                said = _verdict(judge, known, units)
                if said:
                    value, swap, fixed = said
                    out.append((i, source, judge.pages.name(swap) if swap >= 0 else None, value if swap >= 0 else None, sum(f is not None for f in fixed), sum(u[1:-1].count(LOST) for u in units)))
            columns = list(zip(*out)) or [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["_id", "_source", "swap", "log_odds", "n_restorable", "n_lost"])

    rows = model.told(found_runs).select("_id", "_source", "_runs", "_known")
    return rows.mapInArrow(run, "`_id` bigint, `_source` string, `swap` string, `log_odds` double, `n_restorable` int, `n_lost` int")


def _restore(judge: Judge, known: Known, text: str) -> tuple[str, str | None, int, int] | None:
    whole = resolved(text)
    places = runs(whole)
    said = _verdict(judge, known, _units(whole))
    if not said:
        return None
    _, swap, fixed = said
    table = known.table if swap == judge.pages.learned else judge.pages.tables[swap] if 0 <= swap < len(judge.pages.single) else None
    parts, at = [], 0
    for (a, b), f in zip(places, fixed):
        parts.append(whole[at:a])
        run = whole[a:b]
        parts.append(run if f is None else run.translate(table) if table else f)
        at = b
    parts.append(whole[at:])
    return "".join(parts), judge.pages.name(swap) if swap >= 0 else None, sum(f is not None for f in fixed), text.count(LOST)


def restore_documents(documents: DataFrame, key: str, text: str, source: Column, model: Model) -> DataFrame:
    """Documents with a spoiled passage: ``key``, ``swap``, ``n_restored`` runs, ``n_lost`` characters, and ``restored``, the text with every run restored that can be."""
    sent = documents.sparkSession.sparkContext.broadcast(model.bigrams)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(shared_pages(), Bigrams(sent.value))
        for batch in batches:
            out = []
            for i, _, t, known in _rows(batch):
                if t.isascii() and "&" not in t:
                    continue
                fixed = _restore(judge, known, t)
                if fixed:
                    out.append((i, fixed[1], fixed[2], fixed[3], fixed[0]))
            columns = list(zip(*out)) or [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["key", "swap", "n_restored", "n_lost", "restored"])

    rows = documents.select(F.col(key).cast("long").alias("_id"), F.coalesce(source, F.lit("")).alias("_source"), F.col(text).alias("_text")).filter(F.col("_text").isNotNull())
    rows = model.told(rows).select("_id", "_source", "_text", "_known")
    return rows.mapInArrow(run, "`key` bigint, `swap` string, `n_restored` int, `n_lost` int, `restored` string").withColumnRenamed("key", key)


def find_garbled(documents: DataFrame, key: str = "doc_id", text: str = "text", source: Column | None = None, steps: int = STEPS) -> tuple[DataFrame, Model]:
    """The garbled documents and the model. ``key`` is an integer; rows of one key are judged one by one.

    Null, empty and plain ASCII texts are no case; a null source is a source of its own; texts are read whole; repeated rows come out as often as they stand; an empty
    table gives none. Rare characters that were decoded rightly are no case, as nothing they could stand for is likelier in their place.
    """
    found = materialize(document_runs(documents, key, text, F.col("source") if source is None else source), "runs")
    model = learn(found, steps)
    return garbled_documents(found, model).withColumnRenamed("_id", key).withColumnRenamed("_source", "source"), model
