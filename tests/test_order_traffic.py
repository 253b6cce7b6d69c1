"""What the order of events writes on its way: rows that have arrived, and instants that say nothing, aren't carried on."""

from __future__ import annotations

from chronolith.operators import event_order, reachability


def test_arrived_rows_are_written_once(spark, monkeypatch):
    written, settled = [], reachability.settled

    def counting(rows, name):
        out = settled(rows, name)
        if name == "chain-jumps":
            written.append(out.count())
        return out

    monkeypatch.setattr(reachability, "settled", counting)
    edges = [(f"a{i}", f"b{i}") for i in range(300)] + [(f"r{i}", f"r{(i + 1) % 40}") for i in range(40)]
    rows = reachability.chains(spark.createDataFrame(edges, "src string, dst string")).collect()
    assert len(rows) == 640 and sorted(x.pos for x in rows if x.chain == "r0") == list(range(40))
    assert sum(written) <= 3 * 640, written


def test_instants_without_events_are_passed(spark):
    steps = [(f"t{i}", "instantBefore", f"t{i + 1}") for i in range(60)]
    # a branch that comes together again, a ring that nothing leads to, and two events of one instant
    steps += [("t60", "instantBefore", "x"), ("t60", "instantBefore", "y"), ("x", "instantBefore", "z"), ("y", "instantBefore", "z"), ("o1", "instantBefore", "o2"), ("o2", "instantBefore", "o1")]
    times = [("first", "hasTime", "t3"), ("second", "hasTime", "t40"), ("third", "hasTime", "z"), ("fourth", "hasTime", "z"), ("none", "hasTime", "lone")]
    quads = spark.createDataFrame(steps + times, "s string, p string, o string")
    nodes = {x for r in event_order.order_edges(quads).collect() for x in (r.src, r.dst)}
    assert len(nodes) <= 8, nodes
    after = {tuple(x) for x in event_order.before(event_order.order_of(quads)).collect()}
    assert after == {("first", "second"), ("first", "third"), ("first", "fourth"), ("second", "third"), ("second", "fourth")}
