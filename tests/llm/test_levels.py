import random

from modalith.llm import toolcalls


def plain(needs):
    """Kahn by hand: {id: level}."""
    level = {}
    while new := {i: max((level[n] + 1 for n in ns), default=0) for i, ns in needs.items() if i not in level and all(n in level for n in ns)}:
        level |= new
    return level


def run(spark, needs):
    calls = spark.createDataFrame([(c, i) for c, part in needs.items() for i in part], "conv_id long, id string")
    rows = [(c, i, n) for c, part in needs.items() for i, ns in part.items() for n in ns]
    return {(r.conv_id, r.id): r.level for r in toolcalls.levels(calls, spark.createDataFrame(rows, "conv_id long, id string, need string")).collect()}


def test_chain_takes_few_tables(spark, monkeypatch):
    made, write = [], toolcalls.materialize
    monkeypatch.setattr(toolcalls, "materialize", lambda df: made.append(1) or write(df))
    chain = {1: {str(k): {str(k - 1)} if k else set() for k in range(40)}}
    assert run(spark, chain) == {(1, str(k)): k for k in range(40)}
    assert len(made) < 20


def test_chain_longer_than_the_former_cap(spark):
    chain = {1: {str(k): {str(k - 1)} if k else set() for k in range(10_100)}}
    assert run(spark, chain) == {(1, str(k)): k for k in range(10_100)}


def test_graphs_with_chains_joins_and_cycles(spark):
    graphs = {}
    for c in range(12):
        draw = random.Random(c)
        size = 25
        part = {str(k): {str(draw.randrange(k)) for _ in range(draw.choice((1, 1, 1, 2)))} if k and draw.random() < 0.9 else set() for k in range(size)}
        if c % 3 == 0:
            part["5"], part["9"] = {"9"}, {"5", "3"} if c % 2 else {"5"}
            part["7"] = {"7"}
        graphs[c] = part
    assert run(spark, graphs) == {(c, i): l for c, part in graphs.items() for i, l in plain(part).items()}
