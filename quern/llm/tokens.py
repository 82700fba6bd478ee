"""Token ids of a whole corpus under a public byte-level BPE, by corpus-level merge replay.

A merge acts inside one pre-token ("word"), so a corpus is encoded by encoding its distinct words, each once:

1. Texts are split into words, in blocks of bounded size; a block keeps the list of its distinct words and each of its texts as numbers into that list.
2. The distinct words of all blocks are the corpus's words. All merges are replayed over them: an inverted index leads from a pair of tokens to the places where it
   stands in the words, merges are applied in order of rank, and each application touches only the two neighbours of its place. As no pair crosses a word's end,
   the index is parted by word: each partition of the words replays its own, all at once.
3. The ids of words go back to the blocks by a join on the word (a word is there once a block, so no word is hot), and each text's numbers are replaced by ids.

Texts themselves are not shuffled, only their numbers.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.plans.materialize import materialize

DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed value: the published split into words of the byte-level vocabularies.
WORD_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of text in a block, and bytes of words replayed at a time; both bound a task's memory, neither changes a result. A longer text is a block of its own.
BLOCK_CHARS, REPLAY_BYTES = 8_000_000, 8_000_000


class Merges:
    """The vocabulary: the id of each byte, and the id each pair of ids merges into. The id order is the merge order, which ``load`` checks."""

    def __init__(self, byte_ids: list[int], pairs: dict[int, int]):
        self.byte_ids, self.pairs = byte_ids, pairs

    @staticmethod
    def load(path: str = DEFAULT_TOKENIZER) -> Merges:
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model = whole["model"]
        vocabulary = model["vocab"]
        spec = json.dumps(whole.get("pre_tokenizer"))
        if '"ByteLevel"' not in spec or '"add_prefix_space": true' in spec or '"Regex"' in spec:
            raise ValueError(f"{path} doesn't split texts by the byte-level pattern")
        # the published rule of the byte alphabet: printable bytes stand for themselves, the others follow from 256 on
        printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        other = [b for b in range(256) if b not in set(printable)]
        letter = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(other)}
        pairs = {}
        for merge in model["merges"]:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            pairs[vocabulary[a] << 32 | vocabulary[b]] = vocabulary[a + b]
        made = list(pairs.values())
        if any(a >= b for a, b in zip(made, made[1:])):
            raise ValueError(f"the ids of {path} don't rise in the order of its merges")
        return Merges([vocabulary[letter[b]] for b in range(256)], pairs)


    def sizes(self) -> np.ndarray:
        """The number of bytes that each id stands for."""
        out = np.zeros(max([*self.byte_ids, *self.pairs.values()]) + 1, np.int64)
        out[self.byte_ids] = 1
        for pair, made in self.pairs.items():  # in order of merges, so both parts are known
            out[made] = out[pair >> 32] + out[pair & 0xFFFFFFFF]
        return out


def replay(words: list[bytes], merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all words, one after the other, and the number of ids of each word."""
    byte_ids, pairs = merges.byte_ids, merges.pairs
    token: list[int] = []
    for w in words:
        token += [byte_ids[b] for b in w]
        token.append(-1)  # no pair crosses a word's end
    after = list(range(1, len(token) + 1))
    before = list(range(-1, len(token) - 1))
    places: dict[int, list[int]] = {}
    for i in range(len(token) - 1):
        a, b = token[i], token[i + 1]
        if a >= 0 and b >= 0:
            pair = a << 32 | b
            if pair in pairs:
                places.setdefault(pair, []).append(i)
    queue = [(pairs[p], p) for p in places]
    heapq.heapify(queue)
    while queue:
        made, pair = heapq.heappop(queue)
        a, b = pair >> 32, pair & 0xFFFFFFFF
        at = places.pop(pair)
        at.sort()  # of overlapping places the left one merges
        for i in at:
            if token[i] != a:
                continue
            j = after[i]
            if token[j] != b:
                continue
            k = after[j]
            token[i], token[j] = made, -2
            after[i], before[k] = k, i
            left = token[before[i]] if before[i] >= 0 else -1
            right = token[k]
            for x, y, place in ((left, made, before[i]), (made, right, i)):
                if x >= 0 and y >= 0:
                    new = x << 32 | y
                    result = pairs.get(new)
                    if result is not None:
                        there = places.get(new)
                        if there is None:
                            places[new] = [place]
                            heapq.heappush(queue, (result, new))
                        else:
                            there.append(place)
    left_over = np.array(token, dtype=np.int64)
    left_over = left_over[left_over != -2]
    ends = np.flatnonzero(left_over == -1)
    return left_over[left_over >= 0].astype(np.int32), np.diff(ends, prepend=-1) - 1


def _blocks(texts: Iterator[tuple[int, str | None]], most: int) -> Iterator[list[tuple[int, str | None]]]:
    """Numbered texts in lists of about ``most`` characters; a text is never cut."""
    block, size = [], 0
    for row in texts:
        block.append(row)
        size += len(row[1] or "") + 16
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


BLOCK, WORDS, AT = "__quern_block", "__quern_words", "__quern_at"


def _split(df: DataFrame, text: str, keep: list[str], most: int) -> DataFrame:
    """Two kinds of rows: ``keep`` columns, block and word numbers of a text; or a block and its distinct words (``keep`` null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find, part, block = regex.compile(WORD_PATTERN).findall, TaskContext.get().partitionId(), 0
        kinds = None
        for batch in batches:
            kinds = kinds or [batch.schema.field(i).type for i in range(len(keep))]
            for rows in _blocks(enumerate(batch.column(batch.num_columns - 1).to_pylist()), most):
                index: dict[str, int] = {}
                numbers: list[int] = []
                ends = [0]
                for _, t in rows:
                    if t:
                        numbers += [index.setdefault(w, len(index)) for w in find(t)]
                    ends.append(len(numbers))
                name, n = part << 32 | block, len(rows)
                block += 1
                at = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(numbers, pa.int32()))
                kept = [batch.column(i).slice(rows[0][0], n) for i in range(len(keep))]
                words = pa.array([None] * n, pa.list_(pa.binary()))
                yield pa.RecordBatch.from_arrays([*kept, pa.array([name] * n, pa.int64()), at, words], names=[*keep, BLOCK, AT, WORDS])
                words = pa.array([[w.encode("utf-8", "surrogatepass") for w in index]], pa.list_(pa.binary()))
                yield pa.RecordBatch.from_arrays([*(pa.nulls(1, k) for k in kinds), pa.array([name], pa.int64()), pa.nulls(1, pa.list_(pa.int32())), words], names=[*keep, BLOCK, AT, WORDS])

    fields = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep)
    return df.select(*keep, text).mapInArrow(run, f"{fields}`{BLOCK}` bigint, `{AT}` array<int>, `{WORDS}` array<binary>")


def replay_words(words: DataFrame, path: str) -> DataFrame:
    """``word``, ``ids`` for the distinct words (one binary column ``word``)."""
    merges = words.sparkSession.sparkContext.broadcast(Merges.load(path))  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0

        def done() -> pa.RecordBatch:
            ids, counts = replay(held, merges.value)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids, pa.int32()))
            return pa.RecordBatch.from_arrays([pa.array(held, pa.binary()), lists], names=["word", "ids"])

        for batch in batches:
            for w in batch.column(0).to_pylist():
                held.append(w)
                size += len(w)
                if size >= REPLAY_BYTES:
                    yield done()
                    held, size = [], 0
        if held:
            yield done()

    return words.mapInArrow(run, "word binary, ids array<int>")


def _encoded(df: DataFrame, text: str, keep: list[str], out: str, kind: str, path: str, most: int) -> DataFrame:
    split = materialize(_split(df, text, keep, most), "words")
    placed = split.filter(F.col(WORDS).isNotNull()).select(F.col(BLOCK).alias("block"), F.posexplode(WORDS).alias("at", "word"))
    known = replay_words(placed.select("word").distinct(), path)
    told = known.select("word", F.size("ids").alias("ids")) if kind == "count" else known
    # a block's words in their order: bounded by the block
    blocks = placed.join(told, "word").groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "ids"))), lambda x: x["ids"]).alias("ids"))
    texts = split.filter(F.col(WORDS).isNull()).drop(WORDS)

    def put(left: pa.Table, right: pa.Table) -> pa.Table:
        at = left.column(AT).combine_chunks()
        numbers, ends = np.asarray(at.flatten()), np.asarray(at.offsets, dtype=np.int64)
        ends = ends - ends[0]
        lists = right.column("ids").combine_chunks().flatten() if "ids" in right.column_names and right.num_rows else None  # a block without any word
        if lists is None:
            column = pa.array([0] * left.num_rows, pa.int64()) if kind == "count" else pa.array([[]] * left.num_rows, pa.list_(pa.int32()))
        elif kind == "count":
            sums = np.concatenate([[0], np.cumsum(np.asarray(lists, dtype=np.int64)[numbers])])
            column = pa.array(sums[ends[1:]] - sums[ends[:-1]], pa.int64())
        else:
            starts = np.asarray(lists.offsets, dtype=np.int64)
            ids, counts = np.asarray(lists.flatten()), np.diff(starts)
            starts = starts[:-1] - starts[0]
            each = counts[numbers]
            upto = np.concatenate([[0], np.cumsum(each)])
            take = np.repeat(starts[numbers] - upto[:-1], each) + np.arange(upto[-1])
            column = pa.ListArray.from_arrays(pa.array(upto[ends].astype(np.int32)), pa.array(ids[take], pa.int32()))
        return pa.table([*(left.column(c) for c in keep), column], names=[*keep, out])

    fields = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep)
    schema = f"{fields}`{out}` {'array<int>' if kind == 'ids' else 'bigint'}"
    return texts.groupBy(BLOCK).cogroup(blocks.groupBy("block")).applyInArrow(put, schema)


def encode_corpus(df: DataFrame, text: str = "text", keep: list[str] | None = None, out: str = "ids", path: str = DEFAULT_TOKENIZER, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``keep`` columns and the list of token ids of ``text`` for every row, without special tokens (their strings are ordinary text).

    Null and empty texts give an empty list. Texts are encoded whole, whatever their length; repeated rows come out as often as they stand.
    """
    return _encoded(df, text, ["doc_id"] if keep is None else keep, out, "ids", path, block_chars)


def count_tokens(df: DataFrame, text: str = "text", keep: list[str] | None = None, out: str = "n_tokens", path: str = DEFAULT_TOKENIZER, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """As ``encode_corpus``, with the number of ids (0 for null and empty texts) in place of the ids."""
    return _encoded(df, text, ["doc_id"] if keep is None else keep, out, "count", path, block_chars)
