import random

import pytest

from jobmargin.llm import lines, mixing


def brute_repeats(rows, words):
    """Lines of (id, text) rows that lie in a run of enough words standing earlier."""
    parts = [[line.strip(" \t\r\f\v") for line in (t or "").split("\n")] for _, t in rows]
    order = sorted(range(len(rows)), key=lambda r: (rows[r][0] is None, rows[r][0] or 0))
    seen, gone = set(), {r: set() for r in order}
    for r in order:
        full = [i for i, line in enumerate(parts[r]) if line]
        for a in range(len(full)):
            for b in range(a, len(full)):
                run = tuple(parts[r][i] for i in full[a:b + 1])
                if sum(line.count(" ") + 1 for line in run) >= words:
                    if run in seen:
                        gone[r] |= set(range(full[a], full[b] + 1))
                    seen.add(run)
    return gone


def test_repeats_against_all_runs(spark):
    rng = random.Random(8)
    pool = ["a b c", "d e f g", "h", "", "i j k l m n o p q r s t u v w x y z", "two words", "  h\t"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(12)))) for i in range(60)]
    rows += [(None, rows[5][1]), (70, None), (71, ""), (72, "x " * 40 + "\n" + "x " * 40 + "\r\n" + "y"), (73, "z\n" * 200)]
    docs = spark.createDataFrame([(i, t, "n") for i, t in rows], "doc_id long, text string, runs string").repartition(3)
    gone = brute_repeats(rows, 10)
    found = {r.doc_id: r for r in lines.delete_repeats(docs, 10).collect()}
    assert len(found) == len(rows)
    for k, (i, text) in enumerate(rows):
        whole = (text or "").split("\n")
        kept = "\n".join(line for n, line in enumerate(whole) if n not in gone[k])
        assert (found[i].text or "") == kept and found[i].removed_lines == len(gone[k]) and found[i].n_lines == len(whole)
    assert found[70].text is None and sum(map(len, gone.values())) > 100
    assert lines.delete_repeats(docs.limit(0)).count() == 0


def test_rows_that_repeat_are_treated_alike(spark):
    text = "some line of words\nother"
    docs = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in lines.delete_repeats(docs, 3).collect()) == [(1, text), (1, text), (2, "")]


def brute_fill(budget, rooms, weights):
    """Shares by repeated splitting among nodes that have room left."""
    share, open_ = {}, set(rooms)
    while open_:
        left = budget - sum(share.values())
        total = sum(weights[n] for n in open_)
        full = [n for n in open_ if rooms[n] * total <= left * weights[n]]
        if not full:
            return share | {n: min(rooms[n], max(left, 0) * weights[n] // total) for n in open_}
        share |= {n: rooms[n] for n in full}
        open_ -= set(full)
    return share


def test_budgets(spark):
    rng = random.Random(2)
    leaves = [(f"domain{d}", lang, f"s{s}", rng.choice([0, 5, 50, 500, 3000])) for d in range(3) for lang in ("en", "de", "xx") for s in range(4)]
    target = mixing.Target(percent=55, max_epochs=2, weights={"domain": {"domain0": 5, "domain1": 0}, "lang": {"en": 3}})
    df = spark.createDataFrame([(*leaf, 10) for leaf in leaves], "domain string, lang string, source string, tokens long, n_docs long")
    got = {(r.domain, r.lang, r.source): r.share for r in mixing.budgets(df, target).collect()}
    use = {leaf[:3]: 2 * leaf[3] for leaf in leaves if leaf[0] != "domain1"}
    budget = sum(v // 2 for v in use.values()) * 55 // 100
    weight = {"domain0": 5, "en": 3}
    expected, shares = {}, {(): budget}
    for depth in (1, 2, 3):
        for parent in [p for p in shares if len(p) == depth - 1]:
            rooms = {}
            for leaf, room in use.items():
                if leaf[:depth - 1] == parent:
                    rooms[leaf[:depth]] = rooms.get(leaf[:depth], 0) + room
            shares |= brute_fill(shares[parent], rooms, {n: weight.get(n[-1], 1) for n in rooms})
    expected = {n: s for n, s in shares.items() if len(n) == 3}
    assert got == expected


def test_mix(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randrange(0, 30), rng.choice(["en", "de", None]), rng.choice(["src1"] * 5 + ["src2", "x", None]), 0) for i in range(300)]
    rows += [rows[0], (None, "n n", "en", "src1", 0), (400, None, None, None, 0), (401, "v " * 30000, "de", "src2", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, epoch int")
    one = mixing.mix(docs, mixing.Target(percent=100, max_epochs=1))
    assert one.columns == docs.columns and one.count() == len(rows)
    target = mixing.Target(percent=50, weights={})
    chosen = mixing.select(docs, target).collect()
    assert len({(r.doc_id, r.key, r.epoch) for r in chosen}) == len(chosen)
    shares = {(r.domain, r.lang, r.source): r for r in mixing.budgets(spark.createDataFrame([
        (*k, sum(r.n_tokens * r.copies for r in mixing.units(docs, mixing.domain_of(docs.source)).collect() if (r.domain, r.lang, r.source) == k), 1)
        for k in {(r.domain, r.lang, r.source) for r in mixing.units(docs, mixing.domain_of(docs.source)).collect()}
    ], "domain string, lang string, source string, tokens long, n_docs long"), target).collect()}
    for leaf, own in shares.items():
        taken = sum(r.n_tokens * r.copies for r in chosen if (r.domain, r.lang, r.source) == leaf)
        assert taken <= own.share
    again = mixing.select(docs.repartition(7), target).collect()
    assert sorted(map(str, again)) == sorted(map(str, chosen))
    assert mixing.mix(docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op1_line_dedup", "op3_source_mixing"])
def test_statements(spark, name):
    import duckdb

    from jobmargin.llm.queries import QUERIES, STATEMENTS

    folder = "/root/testdata/sf0.001"
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    got = QUERIES[name](spark, folder)
    expected = duckdb.sql(STATEMENTS[name])
    order = [expected.columns.index(c) for c in got.columns]
    assert sorted(map(tuple, got.collect())) == sorted(tuple(row[i] for i in order) for row in expected.fetchall())
