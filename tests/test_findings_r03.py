"""What the third review found: results on odd tables against the SQL, and whole jobs on small ones."""

import duckdb

import __spark_entry__ as entry
from test_queries import plain


def both(spark, folder, name, **tables):
    """The rows of a query over tables (rows, schema), as Spark and as the SQL give them."""
    duck = duckdb.connect()
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    df = entry.queries()[name](spark, str(folder))
    found = duck.execute(entry.oracle_sql()[name])
    names, columns = [d[0] for d in found.description], sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    return got, sorted(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in found.fetchall())


def test_ranges_of_fractions_and_without_ends(spark, tmp_path):
    rows = [(1, 10, 2.5, 1), (1, 17, 1.0, 2), (1, 18, 1.0, 3), (2, 5, None, 1), (2, 5, 1.0, 2), (2, None, 2.0, 3), (2, 7, 3.5, 4)]
    got, want = both(spark, tmp_path, "G4_merge_ranges", lineitem=(rows, "l_orderkey long, l_partkey long, l_quantity double, l_linenumber int"))
    assert got == want


def test_alphabet_gap_with_empty_texts(spark, tmp_path):
    got, want = both(spark, tmp_path, "B2_alphabet_gap", documents=([(i, "" if i == 0 else "abc"[: 1 + i % 3] + "é漢😀" * (i == 3)) for i in range(40)] + [(41, None)], "doc_id long, text string"))
    assert got == want and "('',)" in got


def test_simple_upper_case(spark, tmp_path):
    starts = "ßŉǰΐևẖᾀᾳῃῶﬁﬗaÿǆა1İ"
    got, want = both(spark, tmp_path, "X11_answer_forms", documents=([(4 + 5 * i, f"{c}heit\nund {c}") for i, c in enumerate(starts)], "doc_id long, text string"))
    assert got == want and len(got) == len(starts)


def test_checkpoints_from_one_run_of_the_means(spark, tmp_path):
    rows = [(i, i % 23, "abc"[i % 3], i / 7) for i in range(300)]
    got, want = both(spark, tmp_path, "V12_checkpoints", events=(rows, "event_id long, user_id long, event_type string, value double"))
    assert got == want
    plan = entry.queries()["V12_checkpoints"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation ") == 1  # a second sum of the same doubles may differ in its last bits


def test_openings_without_marks(spark, tmp_path):
    answers = ["A-b c, d e f g h i j k", "ab cdefghij k!", "Abcdefghijklm", "so: 1234567890 x", "so 12345678 90"]
    turns = [(c, t, ("user", "assistant")[t], f"what {c}?" if not t else answers[c % 5]) for c in range(20) for t in (0, 1)]
    tables = {"conversations": (turns, "conv_id long, turn int, role string, text string"), "documents": ([(i, f"line {i}\nx") for i in range(9)], "doc_id long, text string")}
    got, want = both(spark, tmp_path, "V3_readiness", **tables)
    assert got == want


def test_blocks_of_lines_are_bounded(spark, monkeypatch):
    from sparquill.operators import tokens

    sizes, real = [], tokens.staged
    monkeypatch.setattr(tokens, "BLOCK", 500)
    monkeypatch.setattr(tokens, "staged", lambda df, label: sizes.append(df.selectExpr("max(octet_length(ids)) AS m").first()["m"]) or real(df, label))
    lines = [f"{i} " + "ab" * (i % 40) for i in range(400)] + ["long " * 300]
    df = spark.createDataFrame([("\n".join(lines),)], "text string").coalesce(1)
    got = tokens.learnt_merges(df, 5)
    assert max(sizes) == 4 * 1501 and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"
    monkeypatch.setattr(tokens, "BLOCK", 1 << 20)
    assert tokens.learnt_merges(df, 5) == got


def test_similarity_of_all_pairs(spark, tmp_path):
    import random
    import re
    from difflib import SequenceMatcher

    from sparquill.plans.q_joins import d3b

    rng = random.Random(4)
    pool = [f"line {i} of the pool, " + "word " * rng.randint(0, 16) + str(i) for i in range(14)] + ["short", "  blanks   to collapse " + "x" * 40, "", "notice " * 12]
    texts = [[rng.choice(pool) for _ in range(rng.randint(1, 9))] for _ in range(40)]
    texts += [texts[i] for i in (0, 0, 1, 2, 2, 3)] + [[re.sub(" +", " ", x).strip() for x in t] for t in texts[:12]]
    rng.shuffle(texts)
    spark.createDataFrame([(i, "\n".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    bodies = [[y for y in (re.sub(r"\s+", " ", x).strip(" ") for x in t) if y] for t in texts]
    want = {}
    for a, x in enumerate(bodies):
        for b in range(a + 1, len(bodies)):
            y = bodies[b]
            if sum(len(line) for line in set(texts[a]) & set(texts[b]) if len(line) >= 40) >= 100:
                m = SequenceMatcher(None, x, y, autojunk=False)
                n = sum(len(line) for k in m.get_matching_blocks() for line in x[k.a : k.a + k.size])
                if n >= 100 and n / min(sum(map(len, x)), sum(map(len, y))) >= 0.4:
                    want[a, b] = (n, round(n / min(sum(map(len, x)), sum(map(len, y))), 9), round(m.ratio(), 9))
    got = {(r["a"], r["b"]): (r["matched"], round(r["coverage"], 9), round(r["ratio"], 9)) for r in d3b(spark, str(tmp_path)).collect()}
    assert got == want and len(want) > 50


def test_digests_of_lines_travel_to_pairs(spark):
    from sparquill.operators import dedup

    rows = spark.createDataFrame([(d, f"a long line that {n} share " + "x" * 2000) for d in range(6) for n in range(d % 3 + 1)], "doc_id long, line string")
    assert dedup.shared_lines(rows).selectExpr("max(length(h)) AS m").first()["m"] == 36
    got = {(r["a"], r["b"]): r["shared"] for r in dedup.shared_line_pairs(rows, least_shared=3000).collect()}
    size = len("a long line that 0 share ") + 2000
    assert got == {(a, b): size * (min(a % 3, b % 3) + 1) for a in range(6) for b in range(a + 1, 6) if min(a % 3, b % 3) > 0}


def test_nearly_without_shuffled_grams(spark):
    import random

    from sparquill.operators.quotes import nearly

    rng = random.Random(6)
    part = lambda n: "".join(rng.choice("abcdé漢😀") for _ in range(n))
    quotes = [(i, part(rng.randint(5, 60))) for i in range(30)] + [(30, None), (31, "")]
    bodies = [(d, part(rng.randint(0, 30)) + (quotes[rng.randrange(30)][1] or "")[rng.randint(0, 6) :] + part(9)) for d in range(120)]
    bodies += [(200, None), (5, part(20)), (7, quotes[3][1]), (7, quotes[4][1]), (None, quotes[8][1] + "\0" + quotes[9][1]), (900, quotes[8][1])]
    cut = lambda t: {t[k : k + 8] for k in range(len(t or "") - 7)}
    own = {}
    for d, t in bodies:
        own.setdefault(d, set()).update(cut(t))
    want = set()
    for i, t in quotes:
        best = min(((-len(cut(t) & g), d is None, d) for d, g in own.items() if cut(t) & g), default=None)
        if best and -best[0] / len(cut(t)) >= 0.5:
            want.add((i, best[2], -best[0] / len(cut(t))))
    b, q = spark.createDataFrame(bodies, "doc_id long, body string").repartition(5), spark.createDataFrame(quotes, "item_id long, quote string")
    assert [{tuple(r) for r in nearly(b, q, most=n).collect()} for n in (0, 1 << 20)] == [want, want]
    plan = nearly(b.where("doc_id > 7"), q)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan.split("MapInArrow")[1] and len(want) > 20


def test_blocks_of_books_in_one_shuffle(spark, tmp_path):
    import random

    from sparquill.plans.q_segments import j4

    rng = random.Random(3)
    pool = [f"line {i} of a pool, " + "y" * (30 * (i % 5)) for i in range(30)] + ["", "same " * 12]
    run = lambda: pool[(k := rng.randrange(20)) : k + rng.randint(3, 11)]
    docs = [(d, None if d == 7 else "\n".join(sum((run() for _ in range(rng.randint(0, 3))), []))) for d in [*range(40), *range(50, 70)]]
    docs += [(100 + d, "\n".join([*pool[:9], "end"])) for d in range(3)]
    got, want = both(spark, tmp_path, "J4_duplicate_blocks", documents=(docs, "doc_id long, text string"))
    assert got == want and len(got) > 5
    assert j4(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 1


def test_most_common_gram_by_buckets(spark, monkeypatch):
    import random

    from sparquill.operators import aggregates

    rng = random.Random(12)
    for letters, size in (("ab", 25), ("abcdefghij漢😀", 30), ("é", 3)):
        texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, size))) for _ in range(60)] + [None, ""]
        n = {}
        for t in texts:
            for w in {t[i : i + 4] for i in range(len(t or "") - 3)}:
                n[w] = n.get(w, 0) + 1
        df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(3)
        for fullest in (1, 64):
            monkeypatch.setattr(aggregates, "FULLEST", fullest)
            assert aggregates.most_common_gram(df, "t", 4).first()["max_count"] == max(n.values(), default=None)


def test_distractors_in_blocks(spark, tmp_path, monkeypatch):
    from sparquill.operators import distractors

    monkeypatch.setattr(distractors, "BLOCK", 4)
    turns = [(c, t, ("user", "assistant")[t % 2], f"{c} {t}") for c in [*range(60), *range(95, 130), 999] for t in range(2 + 2 * (c % 4 == 0) + 6 * (c % 10 == 3))]
    got, want = both(spark, tmp_path, "J15_distractors", conversations=(turns, "conv_id long, turn int, role string, text string"))
    assert got == want and len(got) > 200
    plan = entry.queries()["J15_distractors"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("MapInArrow")  # pairs are cut down before they are sorted
