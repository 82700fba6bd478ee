import random

import numpy as np
import pytest

from quern.llm import mixing
from quern.llm.mixing import Target, balance, mix_sources, planned_tokens

WORDS = "the block of a run was read from disk and kept in cache".split()
DOCS = "doc_id long, text string, source string, repeats int, n_tokens string"


def corpus(seed, sizes):
    r = random.Random(seed)
    rows, i = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            text = r.choice([None, "", *[" ".join(r.choice(WORDS) for _ in range(r.randrange(1, 60)))] * 8])
            rows.append((i, text, r.choice([source, f" {source.upper()}\t"]) if source else None, 1, "clash"))
            i += 1
    return rows


def report(spark, rows, targets, total=None):
    documents = spark.createDataFrame(rows, DOCS).repartition(3)
    goals = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    chosen, shares = mix_sources(documents, goals, total)
    return chosen.collect(), {r["source"]: r for r in shares.collect()}


def test_shares_are_met_within_the_caps(spark):
    rows = corpus(1, {"a": 600, "b": 120, "c": 300, "other": 50, None: 10})
    chosen, shares = report(spark, rows, [("A ", 0.5, 1), ("b", 0.3, 4), ("c", 0.1, None), ("gone", 0.1, 2)])
    assert len({r["doc_id"] for r in chosen}) == len(chosen) and {r["source"] for r in chosen} == {"a", "b", "c"}
    caps = {"a": 1, "b": 4, "c": 10**9}
    assert all(1 <= r["repeats"] <= caps[r["source"]] and r["n_tokens"] > 0 for r in chosen)
    # the absent source's share goes to the others in proportion
    for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.1)):
        assert shares[s]["actual_share"] == pytest.approx(share / 0.9, abs=0.004)
        assert shares[s]["tokens_chosen"] == sum(r["n_tokens"] * r["repeats"] for r in chosen if r["source"] == s)
    assert shares["gone"]["tokens_chosen"] == 0 and shares["other"]["docs_chosen"] == 0 and None in shares
    # as large as the caps permit: one source gives all it can
    used = {s: shares[s]["tokens_chosen"] / (shares[s]["n_tokens"] * caps[s]) for s in ("a", "b")}
    assert max(used.values()) > 0.99


def test_given_total_fills_what_caps_leave(spark):
    rows = corpus(2, {"a": 100, "b": 400})
    sizes = report(spark, rows, [("a", 0.9, 1), ("b", 0.1, 3)])[1]
    total = int(1.5 * (sizes["a"]["n_tokens"] + sizes["b"]["n_tokens"]))
    _, shares = report(spark, rows, [("a", 0.9, 1), ("b", 0.1, 3)], total)
    assert shares["a"]["tokens_chosen"] == shares["a"]["n_tokens"]
    assert shares["a"]["tokens_chosen"] + shares["b"]["tokens_chosen"] == pytest.approx(total, rel=0.01)


def test_plan():
    t = {"a": Target(0.5, 1), "b": Target(0.5, None), "c": Target(0.2, 0)}
    assert planned_tokens({"a": 10, "b": 10, "c": 10}, t, None) == {"a": 10.0, "b": 10.0}
    assert planned_tokens({"a": 10, "b": 10}, t, 100) == {"a": 10.0, "b": 90.0}
    assert planned_tokens({"b": 10}, t, None) == {"b": 10.0}
    assert planned_tokens({}, t, None) == {}


def test_empty_and_equal_lengths(spark):
    chosen, shares = report(spark, [], [("a", 1.0, 1)])
    assert chosen == [] and shares["a"]["actual_share"] == 0
    chosen, shares = report(spark, corpus(3, {"a": 5}), [])
    assert chosen == [] and shares["a"]["docs_chosen"] == 0
    same = [(i, "one two three", "a" if i % 2 else "b", 1, "") for i in range(40)]
    _, shares = report(spark, same, [("a", 0.25, 1), ("b", 0.75, 1)])
    assert shares["a"]["actual_share"] == pytest.approx(0.25, abs=0.02)


def test_rates_are_tilted_by_tokens(spark):
    # by source: lengths and documents, cap, plan in parts of the tokens
    cases = {"thin": ({10: 500, 100: 300, 900: 40}, 1, 0.2), "grown": ({10: 500, 100: 300, 900: 40}, 3, 1.9), "free": ({7: 90, 50: 100, 60: 10}, None, 4.0), "full": ({10: 5, 100: 3}, 3, 3.0), "whole": ({3: 5, 9: 3}, 1, 1.0)}
    lengths = spark.createDataFrame([(s, n, d) for s, (have, _, _) in cases.items() for n, d in have.items()], "source string, n_tokens int, n_docs long")
    tokens = {s: sum(n * d for n, d in have.items()) for s, (have, _, _) in cases.items()}
    plan = {s: part * tokens[s] for s, (_, _, part) in cases.items()}
    got = balance(lengths, plan, {s: cap for s, (_, cap, _) in cases.items()})
    for s, (have, cap, _) in cases.items():
        b, mean = got[s]
        rate = {n: min(cap or np.inf, np.exp(b * n / mean)) for n in have}
        assert sum(n * d * rate[n] for n, d in have.items()) == pytest.approx(plan[s], rel=1e-8), s
    assert got["thin"][0] < 0 < min(got["grown"][0], got["free"][0]) and got["whole"][0] == 0


def test_copies_follow_the_tilted_rates(spark):
    rows = [(i, " ".join(["block"] * (3 if i % 2 else 40)), "a" if i % 20 < 12 else "b", 1, "") for i in range(4000)]
    chosen, shares = report(spark, rows, [("a", 0.25, 1), ("b", 0.75, 1)])
    assert shares["a"]["actual_share"] == pytest.approx(0.25, abs=0.0005)
    lengths = sorted({r["n_tokens"] for r in chosen})
    part = {n: sum(r["n_tokens"] == n for r in chosen if r["source"] == "a") / 1200 for n in lengths}
    # each length's part is exp(b n) of one b: long documents are thinned out much more than short ones
    assert np.log(part[lengths[0]]) == pytest.approx(np.log(part[lengths[1]]) * lengths[0] / lengths[1], abs=0.05)
    assert part[lengths[0]] > 0.8 > 0.5 > part[lengths[1]]


def test_report_names_the_source_that_bounds_the_mix(spark):
    rows = corpus(5, {"a": 300, "b": 20, None: 5})
    _, shares = report(spark, rows, [("a", 0.5, 1), ("b", 0.5, 2), ("gone", 0.2, 1)])
    assert [s for s in shares if shares[s]["binds"]] == ["b"]
    assert shares["b"]["part_used"] == 2 and shares["gone"]["part_used"] == shares[None]["part_used"] == 0
    assert shares["a"]["part_used"] == shares["a"]["tokens_chosen"] / shares["a"]["n_tokens"] < 0.3
    assert not any(r["binds"] for r in report(spark, rows, [("a", 1.0, None)])[1].values())


def test_no_balance_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_STEPS", 1)
    lengths = spark.createDataFrame([("a", 3, 10), ("a", 900, 10)], "source string, n_tokens int, n_docs long")
    with pytest.raises(ArithmeticError):
        balance(lengths, {"a": 500.0}, {"a": 1})


def test_moments_hold_and_tilt_is_not_zero(spark):
    r = random.Random(4)
    have = {n: r.randrange(1, 90) for n in sorted({int(r.lognormvariate(5, 1.2)) + 1 for _ in range(300)})}
    tokens = sum(n * d for n, d in have.items())
    lengths = spark.createDataFrame([("a", n, d) for n, d in have.items()], "source string, n_tokens int, n_docs long")
    for part, cap in ((0.1, 1), (0.6, 2), (2.5, 3)):
        b, mean = balance(lengths, {"a": part * tokens}, {"a": cap})["a"]
        rate = {n: min(cap, np.exp(b * n / mean)) for n in have}
        assert abs(b) > 0.1 and sum(n * d * rate[n] for n, d in have.items()) == pytest.approx(part * tokens, rel=1e-6)
        assert len({round(x, 6) for x in rate.values()}) > 50
