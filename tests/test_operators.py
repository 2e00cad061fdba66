import random

from pyspark.sql import functions as F

from sparquill.operators import dedup, sampling, segments, tokens
from sparquill.operators.components import connected_components
from sparquill.operators.quotes import containing, located, nearly


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 20)] + [(200, 200), (300, 301), (301, 302), (302, 300), (None, 5)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(31)} == {0} and {got[100 + i] for i in range(20)} == {100} and got[200] == 200 and got[302] == 300
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_merge_ranges(spark):
    rows = [("a", 1, 3), ("a", 4, 5), ("a", 8, 9), ("a", 2, 10), ("b", 1, 1)]
    got = segments.merge_ranges(spark.createDataFrame(rows, "k string, s int, e int"), "k", "s", "e")
    assert sorted(map(tuple, got.collect())) == [("a", 1, 10, 4), ("b", 1, 1, 1)]


def test_duplicate_blocks(spark):
    block = [f"line {i} " + "x" * 120 for i in range(6)]
    text = ["start", *block, "middle", *block, "end"]
    seq = spark.createDataFrame([(1, i, i + 1, t) for i, t in enumerate(text)], "doc_id long, idx long, line_no long, line string")
    assert [tuple(r) for r in segments.duplicate_blocks(seq).collect()] == [(1, 2, 7, 9, 14, 6, sum(map(len, block)))]


def test_as_of(spark):
    left = spark.createDataFrame([(1, 5), (1, 9), (2, 1)], "k int, t int")
    right = spark.createDataFrame([(1, 5, "a"), (1, 7, "b")], "k int, t int, v string")
    assert sorted(map(tuple, segments.as_of(left, right, "k", "t", "v").select("k", "t", "v").collect())) == [(1, 5, "a"), (1, 9, "b"), (2, 1, None)]


def test_early_stopping(spark):
    df = spark.createDataFrame([(1, [3.0, 2.0, 2.0, 2.1, 2.2, 1.0])], "k int, h array<double>")
    assert tuple(sampling.early_stopping(df, "h", 3, 0.0).first()) == (1, 5, 2.0, 2, True)


def test_subset_sum_and_pools(spark):
    sizes = spark.createDataFrame([("a", 5), ("b", 7), ("c", 4), ("d", 9)], "g string, n long")
    chosen = {r["g"] for r in sampling.exact_subset(sizes, "g", "n", 13).collect()}
    assert sum({"a": 5, "b": 7, "c": 4, "d": 9}[g] for g in chosen) == 13
    assert sampling.exact_subset(sizes, "g", "n", 3).count() == 0
    assert sampling.pool_sequence([("a", 2), ("b", 1)], 6).count("a") == 4


def plain_merges(texts, merges, least=2):
    """Merges learnt by counting all adjacent pairs anew each time: most frequent, then smaller left, then right id."""
    lines = [[*line] for t in texts for line in t.split("\n")]
    order = {c: i for i, c in enumerate(sorted({c for line in lines for c in line}))}
    out, dead = [], set()
    while len(out) < merges:
        counts = {}
        for line in lines:
            for pair in zip(line, line[1:]):
                counts[pair] = counts.get(pair, 0) + 1
        live = [(-n, order[a], order[b], a, b) for (a, b), n in counts.items() if n >= least and (a, b) not in dead]
        if not live:
            break
        *_, a, b = min(live)
        if a + b in order:
            dead.add((a, b))
            continue
        order[a + b] = len(order)
        out.append((a, b))
        lines = [plain_apply(line, a, b) for line in lines]
    return out


def plain_apply(tokens_, a, b):
    out, i = [], 0
    while i < len(tokens_):
        if tokens_[i : i + 2] == [a, b]:
            out.append(a + b)
            i += 2
        else:
            out.append(tokens_[i])
            i += 1
    return out


def plain_encode(text, merges):
    """Lowest rank first, leftmost on ties, one pair at a time."""
    rank, t = {p: i for i, p in enumerate(merges)}, [*text]
    while True:
        best = min(((rank.get(p, 1 << 60), i) for i, p in enumerate(zip(t, t[1:]))), default=(1 << 60, 0))
        if best[0] == 1 << 60:
            return t
        t[best[1] : best[1] + 2] = [t[best[1]] + t[best[1] + 1]]


def test_merges_of_all_lines_and_lossless_tokens(spark):
    rng = random.Random(2)
    for letters, n in (("ab", 40), ("abcdefgh ", 300)):
        texts = ["\n".join("".join(rng.choice(letters) for _ in range(rng.randint(0, 9))) for _ in range(n)) + " é漢😀" for _ in range(3)]
        want = plain_merges(texts, 40)
        df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, "", None, "a\0b\n\n ab", "never\tseen"])], "k long, text string")
        assert tokens.learnt_merges(df.where(f"k < {len(texts)}"), 40) == tokens.learnt_merges(df.where(f"k < {len(texts)}"), 40, top=8, restage=3) == want
        for row in tokens.bpe_encoded(df, "text", want, most=64).collect():
            assert row["tokens"] == plain_encode(row["text"] or "", want) and "".join(row["tokens"]) == (row["text"] or "")


def test_first_by_and_crossing(spark):
    df = spark.createDataFrame([(1, "a", 3), (2, "a", 1), (3, "b", 2)], "id int, k string, o int")
    assert sorted(r["id"] for r in dedup.first_by(df, ["k"], [F.col("o")]).collect()) == [2, 3]
    s = spark.createDataFrame([("x", "train"), ("x", "val"), ("y", "val")], "v string, split string")
    assert [tuple(r) for r in dedup.crossing(s, "v").collect()] == [("x", 2, 2)]


def test_shared_lines_of_many_documents(spark):
    notice, other, own = "a notice that a great many documents carry " * 2, "a second line that some of them carry as well", "a line of one document only, of over 40 characters"
    texts = {i: [notice] + [other] * (i % 3 == 0) + [f"{own} {i}"] for i in range(1, 41)}
    want = {(a, b): sum(map(len, set(texts[a]) & set(texts[b]))) for a in texts for b in texts if a < b}
    rows = spark.createDataFrame([(d, i, x) for d, ls in texts.items() for i, x in enumerate(ls)], "doc_id long, line_no int, line string")
    for least in (1, 80, 100, 1000):
        assert {(r["a"], r["b"]): r["shared"] for r in dedup.shared_line_pairs(rows, least_shared=least).collect()} == {k: v for k, v in want.items() if v >= least}
    assert {tuple(r) for r in connected_components(dedup.line_links(rows)).collect()} == {(i, 1) for i in texts}


def test_corpus_overlap_of_common_passages(spark):
    from sparquill.plans.q_metrics import corpus_overlap

    random.seed(1)
    part = lambda n: "".join(random.choice("abcd ") for _ in range(n))
    items = [(i, part(60)) for i in range(6)] + [(6, "zzzzzzz")]
    texts = [part(30) + items[i % 3][1][i % 5 : 50] + part(10) for i in range(900)] + [items[4][1] + items[3][1][:20], None, ""]
    whole = "\n".join(t or "" for t in texts)
    want = {i: max((e - s for s in range(len(t)) for e in range(s + 8, len(t) + 1) if t[s:e] in whole), default=0) for i, t in ((i, t.strip(" ")) for i, t in items)}
    got = corpus_overlap(spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame([(t,) for t in texts], "text string"))
    assert {r["item_id"]: r["overlap"] for r in got.collect()} == {i: n for i, n in want.items() if n}


def test_gaps_and_decoding_of_all_rows(spark, tmp_path):
    from sparquill.plans.q_segments import g16
    from sparquill.plans.q_tokens import b6

    hours = [(u, h) for u in (3, 19, 20, 4000) for h in range(u % 7, 12) if (u + h) % 4 or h in (u % 7, 11)]
    spark.createDataFrame(hours, "user_id long, h long").selectExpr("user_id", "timestamp_seconds(h * 3600 + 5) AS ts").write.parquet(f"{tmp_path}/events.parquet")
    gaps = {u: sorted(set(range(u % 7, 12)) - {h for v, h in hours if v == u}) for u in (3, 19, 20, 4000)}
    assert {(r["user_id"], r["n_missing"], r["first_missing"]) for r in g16(spark, str(tmp_path)).collect()} == {(u, len(g), g[0]) for u, g in gaps.items() if g}
    turns = [(1, 0, ""), (1, 1, "short é漢"), (2, 0, "long 😀 " * 300)]
    spark.createDataFrame(turns, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert sorted(map(tuple, b6(spark, str(tmp_path)).select("conv_id", "turn", "text").collect())) == turns


def test_whole_items_are_searched(spark, tmp_path):
    from sparquill.plans import q_joins

    opening = "An opening that both share, word for word, for well over sixty characters of text: "
    items = [(0, opening + "the true end."), (1, "Short one!"), (2, "..."), (3, opening + "never copied")]
    docs = [(10, "x " + opening + "another end. Short one"), (11, f"say: {opening}the TRUE\nend. And short-one?"), (12, "nothing"), (13, "a " + opening + "the true end.")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, q_joins.f6(spark, str(tmp_path)).select("doc_id", "item_id", "n_items").collect())) == [(10, 1, 1), (11, 0, 2), (13, 0, 1)]
    flat = {d: "".join(t.split()) for d, t in docs}
    want = {(i, d, flat[d].index(q) + 1) for i, q in ((i, "".join(t.split())) for i, t in items) for d in [min((d for d in flat if q in flat[d]), default=None)] if d}
    bodies = spark.createDataFrame(docs, "doc_id long, text string")
    assert {tuple(r) for r in q_joins.j8(spark, str(tmp_path)).collect()} == want and {i for i, *_ in want} == {0}
    quotes = spark.createDataFrame([(i, "".join(t.split())) for i, t in [(4, "thing"), *items]], "item_id long, quote string")
    compact = bodies.selectExpr("doc_id", r"regexp_replace(text, '\\s+', '') AS body")
    hits = [{tuple(r) for r in containing(compact, quotes, most=n).collect()} for n in (0, 1 << 20)]
    every = {(i, d, flat[d].index(q) + 1) for i, q in ((r["item_id"], r["quote"]) for r in quotes.collect()) for d in flat if q in flat[d]}
    assert hits == [every, every]
    claims = spark.createDataFrame([(0, 13), (4, 11)], "item_id long, claimed long")
    got = {r["item_id"]: (r["doc_id"], r["as_claimed"]) for r in located(containing(compact, quotes), claims).collect()}
    assert got[0] == (13, True) and got[4] == (12, False)
    worn = spark.createDataFrame([(7, "".join((opening + "the true end.").split()).replace("word", "w#rd")), (8, "nowhere to be found at all")], "item_id long, quote string")
    assert [(r["item_id"], r["doc_id"]) for r in nearly(compact, worn).collect()] == [(7, 13)]


def test_whole_answers_are_scored(spark, tmp_path):
    from difflib import SequenceMatcher

    from sparquill.plans import q_metrics

    pairs = [("q" * 60 + "the same long ending", "a" * 70 + "the same long ending"), ("b" * 60 + "one", "b" * 60 + "two"), ("same", "Same")]
    turns = [(c, t, ("user", "assistant")[t], x) for c, p in enumerate(pairs) for t, x in enumerate(p)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert {r["id"]: r["common"] for r in q_metrics.m6(spark, str(tmp_path)).collect()} == {0: 20, 1000: 60, 2000: 3}
    shared = lambda a, b: 2 * sum(min(a.count(c), b.count(c)) for c in set(a)) / (len(a) + len(b))
    f1 = {r["id"]: (round(r["f1"], 9), r["exact"]) for r in q_metrics.m10(spark, str(tmp_path)).collect()}
    assert f1 == {1000 * i: (round(shared(a, b), 9), a.lower() == b.lower()) for i, (a, b) in enumerate(pairs)}
    assert {r["id"]: r["ratio"] for r in q_metrics.m11(spark, str(tmp_path)).collect()} == {1000 * i: SequenceMatcher(None, a, b, autojunk=False).ratio() for i, (a, b) in enumerate(pairs)}


def test_components_by_contraction_and_in_one_task_agree(spark):
    rng = random.Random(5)
    edges = spark.createDataFrame([(rng.randrange(400), rng.randrange(400)) for _ in range(300)], "a long, b long")
    whole, rounds = (sorted(map(tuple, connected_components(edges, one_task=n).collect())) for n in (1 << 20, 0))
    assert whole == rounds


def test_grown_contexts(spark, tmp_path):
    from sparquill.plans.q_segments import g13

    rng = random.Random(8)
    docs = [(i, "\n".join("x" * rng.choice([0, 5, 40, 90, 300]) + str(k) for k in range(rng.randrange(1, 12)))) for i in range(12)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = set()
    for d, text in docs:
        sizes = [len(x) for x in text.split("\n")]
        for at in range(len(sizes)):
            inside, turn = [at], 1
            while sum(sizes[i] for i in inside) < 128:
                for side in (turn, -turn):
                    place = max(inside) + 1 if side == 1 else min(inside) - 1
                    if 0 <= place < len(sizes) and sum(sizes[i] for i in inside) + sizes[place] <= 280:
                        inside.append(place)
                        turn = -side
                        break
                else:
                    break
            want.add((d, at + 1, min(inside) + 1, max(inside) + 1))
    assert {tuple(r) for r in g13(spark, str(tmp_path)).select("doc_id", "line_no", "first", "last").collect()} == want


def test_diverse_choice_is_made_over_all_rows(spark):
    import hashlib

    rng = random.Random(9)
    rows = [(i, rng.choice([None, "a", "b", "c"]), rng.randrange(6)) for i in range(300)]
    ordered = sorted(rows, key=lambda r: hashlib.sha256(str(r[0]).encode()).hexdigest())
    for n in (3, 12, 400):
        chosen, seen = [], [set(), set()]
        for test in (all, any, lambda _: True):
            for r in ordered:
                if len(chosen) < n and r not in chosen and test([v not in s for v, s in zip(r[1:], seen)]):
                    chosen.append(r)
                    for v, s in zip(r[1:], seen):
                        s.add(v)
        got = sampling.diverse(spark.createDataFrame(rows, "id long, f string, g long"), "id", ["f", "g"], n)
        assert [r["id"] for r in got.orderBy("place").collect()] == [r[0] for r in chosen]


def test_distinct_places(spark):
    rng = random.Random(10)
    hits = [(rng.choice("abcd"), rng.randrange(9)) for _ in range(40)]
    taken = {}
    for label in "abcd":
        free = sorted({p for x, p in hits if x == label} - set(taken.values()))
        if free:
            taken[label] = free[0]
    got = sampling.distinct_places(spark.createDataFrame(hits, "label string, place long"), "label", "place", 4)
    assert {r["label"]: r["place"] for r in got.collect()} == taken


def test_numbered_within_few_groups(spark):
    rng = random.Random(11)
    rows = [(rng.choice(["x", "y", None]), rng.randrange(50), i) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, o int, id long").repartition(5)
    got = {r["id"]: (r["k"], r["n"]) for r in sampling.numbered_within(df, ["g"], [-F.col("o"), F.col("id")], total=True).collect()}
    for g in ("x", "y", None):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        assert [got[r[2]] for r in own] == [(k, len(own)) for k in range(len(own))]


def test_payload_violations(spark):
    from sparquill.plans.q_records import payload_violations

    rows = [(1, "t", [5, 6, 7], [-100, 6, 7]), (2, "t", [5, 6], [-100]), (3, "t", [5, 6], [-100, 9]), (4, "t", [5, 6], [-100, -100]), (5, "t", [5, 70000], [5, 70000])]
    got = {(r["id"], r["code"]) for r in payload_violations(spark.createDataFrame(rows, "id int, split string, ids array<int>, labels array<int>")).collect()}
    assert got == {(2, "length_mismatch"), (2, "nothing_supervised"), (3, "label_not_input"), (4, "nothing_supervised"), (5, "prompt_supervised"), (5, "outside_vocabulary")}
