"""Unknown code-page swaps as substitution ciphers: a mapping of symbols to letters learned by expectation-maximization against letter bigrams.

What a source shows of a cipher is how often which symbols stand side by side where all other text makes them unlikely neighbours. Such pair counts are all that
is needed: their number is bounded by the alphabet, however many texts a source has. With ``P`` the joint probabilities of letter pairs in clean text and ``E`` the
chance that a letter is written as a symbol, a pair of symbols has probability ``(E P E')``; the E step shares each pair's count out to pairs of letters, the M step sums the
shares. ASCII stands for itself. Starts are the public pages, runs of the alphabet at each distance from the byte numbers, and no knowledge at all; the likeliest end is kept,
so the result may leave the page it started from.

A source that holds more than half of all text has no mapping: there is too little other text to tell what is unlikely in it.
"""

from __future__ import annotations

import numpy as np

#: Steps of a run, starts that are followed to the end, and the weight of the unknown beside a start's letter.
STEPS, STARTS, OPEN = 25, 6, 0.15
#: A symbol is learned if it stands in so many pairs, and a cipher needs so many symbols and pairs in all.
SYMBOL_PAIRS, LEAST_SYMBOLS, LEAST_PAIRS = 4.0, 3, 250.0
#: By how many nats a pair the deciphered text must be likelier than the given one, and how near it must come to clean text in the same letters.
GAIN, FIT = 1.5, 0.5
#: Part of a symbol's pairs that must speak for its letter.
SURE = 0.35
#: Letters that stand in fewer clean pairs can't be learned.
LETTER_PAIRS = 12.0
SMOOTH = 0.3


def is_ascii(c: str) -> bool:
    return c < "\x80"


Pairs = dict[tuple[str, str], float]
Margins = tuple[dict[str, float], dict[str, float], float]


def margins(pairs: Pairs) -> Margins:
    """How often each symbol comes first and second, and the number of all pairs."""
    first: dict[str, float] = {}
    second: dict[str, float] = {}
    for (a, b), n in pairs.items():
        first[a] = first.get(a, 0.0) + n
        second[b] = second.get(b, 0.0) + n
    return first, second, sum(first.values())


def unexplained(pairs: Pairs, clean: Pairs, whole: Margins) -> Pairs:
    """A source's pairs that all other text makes no likelier than chance: ``clean`` (and its margins ``whole``) less what the source itself gave it."""
    own = margins(pairs)
    total = max(whole[2] - own[2], 0.0)
    if total < own[2]:  # a source of most of the text: what is usual can't be told from what is its own
        return {}
    out = {}
    for (a, b), n in pairs.items():
        # the count to expect if neighbours were independent; letters that other text hardly has count as chance
        first, second = whole[0].get(a, 0.0) - own[0][a], whole[1].get(b, 0.0) - own[1][b]
        if max(clean.get((a, b), 0.0) - n, 0.0) <= (max(first, 0.0) + 1) * (max(second, 0.0) + 1) / (total + 1):
            out[a, b] = n
    return out


class _Fit:
    """EM over pair counts ``n`` (tokens x tokens) with letter pairs ``p`` (letters x letters); the first tokens and letters are ASCII and stand for themselves."""

    def __init__(self, n: np.ndarray, p: np.ndarray, fixed: int):
        self.n, self.p, self.fixed = n, p, fixed

    def emission(self, table: np.ndarray) -> np.ndarray:
        """E from a start: ``table`` (symbols x letters beyond ASCII) of weights."""
        f = self.fixed
        e = np.zeros((self.n.shape[0], self.p.shape[0]))
        e[:f, :f] = np.eye(f)
        e[f:, f:] = table / np.maximum(table.sum(axis=0, keepdims=True), 1e-12)
        return e

    def step(self, e: np.ndarray) -> tuple[np.ndarray, float]:
        """Expected counts of (symbol, letter) and the log likelihood."""
        after, before = e @ self.p, e @ self.p.T
        z = after @ e.T + 1e-12
        share = self.n / z
        counts = e * (share @ before) + e * (share.T @ after)
        return counts[self.fixed :, self.fixed :], float((self.n * np.log(z)).sum())

    def run(self, table: np.ndarray, steps: int) -> tuple[np.ndarray, float]:
        prior = table / np.maximum(table.sum(axis=1, keepdims=True), 1e-12)
        like = -np.inf
        for _ in range(steps):
            counts, like = self.step(self.emission(table))
            table = counts + 0.05 * prior
        return table, like


def _starts(symbols: list[str], letters: list[str], byte: dict[str, int], pages: list[dict[int, str]], weight: np.ndarray) -> list[np.ndarray]:
    at = {c: i for i, c in enumerate(letters)}
    m, k = len(symbols), len(letters)
    maps: list[dict[int, int]] = []
    for page in pages:
        maps.append({i: at[page[byte[s]]] for i, s in enumerate(symbols) if page.get(byte[s]) in at})
    for offset in sorted({ord(a) - byte[s] for a in letters for s in symbols}):
        maps.append({i: at[chr(byte[s] + offset)] for i, s in enumerate(symbols) if 0 <= byte[s] + offset < 0x110000 and chr(byte[s] + offset) in at})
    # starts that say something of half the symbols
    maps = [x for x in maps if sum(weight[i] for i in x) >= 0.5 * weight.sum()]
    out = []
    for x in {tuple(sorted(x.items())) for x in maps}:
        table = np.full((m, k), OPEN / k)
        for i, j in x:
            table[i, j] += 1 - OPEN
        out.append(table)
    return [*out, np.full((m, k), 1.0 / k)]


def learn_cipher(pairs: Pairs, clean: Pairs, whole: Margins, pages: list[dict[str, int]], rows: list[dict[int, str]]) -> dict[str, str]:
    """The letters of a source's symbols, empty if there is no cipher. ``pairs``: the source's neighbours, ``clean``: all clean text's, both by symbol, ``whole``: its margins.

    ``pages``: for each page that text may have been read as, its letters' bytes; ``rows``: the letters of the bytes in pages that text may have been written in (starts only).
    """
    odd = unexplained(pairs, clean, whole)
    inner = lambda c, byte: is_ascii(c) or c in byte
    mass = [sum(n for (a, b), n in odd.items() if (a in byte or b in byte) and inner(a, byte) and inner(b, byte)) for byte in pages]
    if not mass or max(mass) < LEAST_PAIRS:
        return {}
    byte = pages[int(np.argmax(mass))]
    odd = {(a, b): n for (a, b), n in odd.items() if (a in byte or b in byte) and inner(a, byte) and inner(b, byte)}
    seen: dict[str, float] = {}
    for pair, n in odd.items():
        for c in pair:
            if c in byte:
                seen[c] = seen.get(c, 0.0) + n
    symbols = sorted(c for c, n in seen.items() if n >= SYMBOL_PAIRS and (c.isalpha() or c.isprintable()))
    if len(symbols) < LEAST_SYMBOLS:
        return {}
    base = {p: max(n - odd.get(p, 0.0), 0.0) for p, n in clean.items()}
    often: dict[str, float] = {}
    for (a, b), n in base.items():
        often[a] = often.get(a, 0.0) + n
        often[b] = often.get(b, 0.0) + n
    # letters of small alphabets; classes of large scripts can't be told apart
    letters = sorted(c for c, n in often.items() if n >= LETTER_PAIRS and not is_ascii(c) and c.isalpha() and ord(c) < 0x2E80)
    if not letters:
        return {}
    ascii_ = sorted({c for p in odd for c in p if is_ascii(c)} | {c for c in often if is_ascii(c)})
    tokens, alphabet = ascii_ + symbols, ascii_ + letters
    ti, li = {c: i for i, c in enumerate(tokens)}, {c: i for i, c in enumerate(alphabet)}
    n = np.zeros((len(tokens), len(tokens)))
    for (a, b), x in odd.items():
        if a in ti and b in ti:
            n[ti[a], ti[b]] += x
    p = np.zeros((len(alphabet), len(alphabet)))
    for (a, b), x in base.items():
        if a in li and b in li:
            p[li[a], li[b]] += x
    if n.sum() < LEAST_PAIRS:
        return {}
    single = p.sum(axis=1) + p.sum(axis=0)
    p = p + SMOOTH * np.outer(single, single) / max(single.sum(), 1e-12) / max(single.sum(), 1e-12) * len(alphabet)
    p /= p.sum()
    f = len(ascii_)
    fit = _Fit(n, p, f)
    weight = n[f:].sum(axis=1) + n[:, f:].sum(axis=0)
    ends = [(fit.run(t, 3)[1], i, t) for i, t in enumerate(_starts(symbols, letters, byte, rows, weight))]
    ends = sorted(ends, key=lambda x: (-x[0], x[1]))[:STARTS]
    table, _ = max((fit.run(t, STEPS) for _, _, t in ends), key=lambda x: x[1])
    best = table.argmax(axis=1)
    # a letter goes to the symbol that shows it most; others of the same letter are left as they are
    learned: dict[str, str] = {}
    taken: set[int] = set()
    for i in np.argsort(-table.max(axis=1)):
        if best[i] not in taken and table[i, best[i]] >= max(SYMBOL_PAIRS / 2, SURE * table[i].sum()):
            taken.add(int(best[i]))
            if letters[best[i]] != symbols[i]:
                learned[symbols[i]] = letters[best[i]]
    # how likely the deciphered, the given, and clean text in these letters are, by pair
    row, column = p.sum(axis=1), p.sum(axis=0)
    lift = lambda a, b: float(np.log((p[li[a], li[b]] + 1e-15) / (row[li[a]] * column[li[b]] + 1e-15))) if a in li and b in li else -3.0
    gain: dict[str, list[float]] = {s: [0.0, 0.0] for s in learned}
    for (a, b), x in odd.items():
        if a in ti and b in ti:
            more = x * (lift(learned.get(a, a), learned.get(b, b)) - min(lift(a, b), 0.0))
            for c in {a, b} & set(learned):
                gain[c][0] += more
                gain[c][1] += x
    learned = {s: x for s, x in learned.items() if gain[s][0] >= GAIN * gain[s][1]}
    if len(learned) < LEAST_SYMBOLS:
        return {}
    changed = [(x, lift(learned.get(a, a), learned.get(b, b))) for (a, b), x in odd.items() if a in ti and b in ti and (a in learned or b in learned)]
    used = set(learned.values())
    usual = [(x, lift(a, b)) for (a, b), x in base.items() if a in li and b in li and (a in used or b in used)]
    mean = lambda rows: sum(x * y for x, y in rows) / max(sum(x for x, _ in rows), 1e-12)
    enough = LEAST_PAIRS <= sum(x for x, _ in changed) <= sum(x for x, _ in usual)  # clean text must show these letters more often than the cipher does
    return learned if enough and mean(changed) >= mean(usual) - FIT else {}
