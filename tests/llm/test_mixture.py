from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st

from quarrykit.llm import mixture


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=4), st.lists(st.integers(0, 60), min_size=1, max_size=3), st.data())
def test_flow_keeps_caps_and_is_greatest(supply, quota, data):
    access = [data.draw(st.dictionaries(st.integers(0, len(quota) - 1), st.one_of(st.none(), st.integers(0, 3)), max_size=3)) for _ in supply]
    got = mixture.flow(supply, access, quota)
    for s in range(len(quota)):
        assert sum(g.get(s, 0) for g in got) <= quota[s]
    for p, g in enumerate(got):
        assert all(c is None or x <= c * supply[p] for s, x in g.items() for c in [access[p][s]])
    # the greatest flow by the theorem of cuts: some set of sources is short by what all others can give
    import itertools

    best = min(sum(quota[s] for s in range(len(quota)) if s not in cut) + sum(min(quota[s], quota[s] if a[s] is None else a[s] * supply[p]) for p, a in enumerate(access) for s in a if s in cut) for n in range(len(quota) + 1) for cut in itertools.combinations(range(len(quota)), n))
    assert sum(sum(g.values()) for g in got) == best


def test_repeating_costs_more_each_time():
    # the second pattern can serve both sources: the first source takes its own first
    assert mixture.flow([10, 10], [{0: 3}, {0: 3, 1: 3}], [10, 10]) == [{0: 10}, {1: 10}]


def test_mixture(spark):
    docs = [(i, f"word{i} and some more text of this kind", "big" if i < 80 else "small", "x") for i in range(90)] + [(100, "word1 and some more text of this kind", "small", ""), (101, None, "big", ""), (102, "", "small", ""), (103, "alone", None, "")]
    df = spark.createDataFrame(docs, "doc_id int, text string, source string, tokens string")
    plans = spark.createDataFrame([("p", 1.0), ("q", 0.5)], "plan_id string, budget_ratio double")
    targets = spark.createDataFrame([("p", "big", 1.0, 1), ("p", "small", 1.0, 3), ("q", "small", 2.0, None), ("q", "none", 2.0, 1), ("q", "big", 0.0, 1)], "plan_id string, source string, weight double, max_repeats int")
    drawn, shares = mixture.mixed(df, plans, targets)
    rows, table = drawn.collect(), {(r.plan_id, r.source): r for r in shares.collect()}
    assert max(r.times for r in rows if (r.plan_id, r.source) == ("p", "big")) == 1 and max(r.times for r in rows if (r.plan_id, r.source) == ("p", "small")) <= 3
    assert len({(r.plan_id, r.source, r.doc_id) for r in rows}) == len(rows) and {r.source for r in rows if r.doc_id == 100} == {"small"}
    big, small = table[("p", "big")], table[("p", "small")]
    assert abs(big.reached_tokens - big.target_tokens) <= 12 and small.reached_tokens < small.target_tokens and abs(big.reached_share + small.reached_share - 1) < 1e-9
    assert table[("q", "none")].reached_tokens == 0 and table[("q", "big")].reached_tokens == 0 and abs(table[("q", "small")].reached_tokens - table[("q", "small")].target_tokens) <= 12
    assert {tuple(r) for r in mixture.mixed(df, plans, targets)[0].collect()} == {tuple(r) for r in rows}


def test_uses_have_no_upper_level():
    assert mixture.flow([3, 2], [{0: None}, {0: None}], [500]) == [{0: 300}, {0: 200}]
    assert mixture.flow([3], [{0: 150, 1: None}], [450, 30]) == [{0: 450, 1: 30}]


def test_a_source_gives_way_to_another():
    # both sources are open to the first pattern, only one to the second: what the first gave moves on
    assert mixture.flow([10, 10], [{0: 1, 1: 1}, {0: 1}], [10, 10]) == [{1: 10}, {0: 10}]


def test_every_copy_can_be_drawn(spark):
    docs = spark.createDataFrame([(i, "the same text", "a") for i in range(40)] + [(50, "the same text", "b"), (51, "other words", "b")], "doc_id int, text string, source string")
    plans = spark.createDataFrame([("p", 1.0)], "plan_id string, budget_ratio double")
    targets = spark.createDataFrame([("p", "a", 40.0, 1), ("p", "b", 2.0, None)], "plan_id string, source string, weight double, max_repeats int")
    rows = mixture.mixed(docs, plans, targets)[0].collect()
    assert {r.doc_id for r in rows if r.source == "a"} == set(range(40)) and {r.doc_id for r in rows if r.source == "b"} <= {50, 51}
    assert {r.times for r in rows if r.source == "a"} == {1}
