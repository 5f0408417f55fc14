"""Training-data operators against brute force, and on nulls, ties, repeats and empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lobspark.llm import chat_format, jaccard_join, line_dedup, lm_scoring, mixing, quality, sharding, topk_search, url_filters

DOC = "doc_id long, text string, lang string, source string, n_chars long, size string, keys string"
SPLIT = re.compile(r"[\x20\x09-\x0D]+")


def words(t):
    return [w for w in SPLIT.split(t or "") if w]


def texts(n=60, seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(80)] + ["The", "Ünï", "end."]
    out = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 90))).replace(" w3 ", ".\n") + "." for _ in range(n)]
    near = out[0].split(" ")
    for i in range(8):
        near[rng.randrange(len(near))] = f"x{i}"
        out.append(" ".join(near))
    return [*out, out[1], out[1], "", "  \n ", None, "one", "one", "two words", "x " * 4000]


def docs(spark, rows=None):
    rows = texts() if rows is None else rows
    made = [(i, t, None if i % 9 == 0 else "en", None if i % 7 == 0 else f"s{i % 4}", len(t or ""), "clash", "clash") for i, t in enumerate(rows)]
    made += [(None, "null id text here", "en", "s1", 4, "clash", "clash")] * 2 + made[3:5]
    return spark.createDataFrame(made, DOC)


def empty(spark):
    return spark.createDataFrame([], DOC)


def test_quality(spark):
    def repeats(w):
        seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        hit = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        return len(hit)

    got = quality.assess(docs(spark)).collect()
    assert len(got) == docs(spark).count()
    for r in got:
        w, t = words(r["text"]), r["text"] or ""
        lines = [x for x in t.split("\n") if words(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), repeats(w))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(w) < 20 or 100 * want[4] > 30 * len(w)) and not (r["kept"] and r["base_failed"])
    prose = "A plain sentence of some length stands here, and it ends well. " * 1 + "Nothing in it is page furniture, so nobody should take it away."
    nav = "Home | About | Contact |\nlogin\nWe use cookies. Click here.\n" * 6
    page = spark.createDataFrame([(1, prose), (2, prose + "\nHome | News | About |"), (3, nav + prose)], "doc_id long, text string")
    r = {x["doc_id"]: x for x in quality.assess(page).collect()}
    assert r[1]["kept"] and r[2]["kept"] and r[2]["clean_text"] == prose and not r[3]["kept"]
    assert quality.assess(empty(spark)).count() == 0 and quality.clean(docs(spark)).columns == docs(spark).columns


def test_apportion(spark):
    rng = random.Random(5)
    rows = [(g, i, float(rng.choice([0, 1, 5, 40, 333, rng.randint(1, 900)])), seats) for g, n, seats in ((0, 7, 100), (1, 40, 13), (2, 1, 9), (3, 25, 0)) for i in range(n)]
    got = mixing.apportion(spark.createDataFrame(rows, "g int, i int, w double, seats long"), ["g"], "i", "w", "seats", "won")
    got = {(r["g"], r["i"]): r["won"] for r in got.collect()}
    for g in range(4):
        own = {i: w for h, i, w, _ in rows if h == g}
        seats = next(s for h, _, _, s in rows if h == g)
        won = Counter()
        for _ in range(seats):  # one seat at a time to the highest quotient
            won[max(own, key=lambda i: (own[i] / (2 * won[i] + 1), -i))] += 1
        assert {i: won[i] for i in own} == {i: got[g, i] for i in own}


def test_mix(spark):
    d = docs(spark)
    got = mixing.mix(d, shard_words=400, block_words=4).collect()
    size = Counter()
    for r in d.collect():
        size[r["source"]] += len(words(r["text"]))
    order = sorted(k for k in size if k is not None) + [None]
    weight, total = {k: 1 + i % 3 for i, k in enumerate(order)}, sum(size.values())
    held = set()
    while True:  # hold sources at their limit until none is above
        level = (total - sum(3 * size[k] for k in held)) / sum(weight[k] for k in order if k not in held)
        over = {k for k in order if k not in held and weight[k] * level > 3 * size[k]}
        if not over:
            break
        held |= over
    target = {k: 3 * size[k] if k in held else weight[k] * level for k in order}
    taken, wanted = Counter(), {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source_size"], round(r["target"], 6)] += r["taken"]
        wanted[r["source_size"], round(r["target"], 6)] = r["target"]
    assert sorted(wanted.values()) == pytest.approx(sorted(target.values()))
    for k, v in wanted.items():
        assert abs(taken[k] - v) <= 8 + 0.01 * v
    again = mixing.mix(d.repartition(7), shard_words=400, block_words=4).collect()
    key = lambda rs: sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in rs)
    assert key(again) == key(got) and mixing.mix(empty(spark)).count() == 0
    mixed = mixing.mixed_documents(d, shard_words=400, block_words=4)
    assert mixed.columns == d.columns and sum(len(words(r["text"])) for r in mixed.collect()) == sum(r["taken"] for r in got)


def test_lm(spark):
    d = docs(spark)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    lower = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words(t)]
    rows = d.collect()
    is_held = lambda r: r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2
    model = lm_scoring.BackoffAutomaton([lower(r["text"]) for r in rows if not is_held(r)], (9.0, 3.0))
    got = lm_scoring.score_texts(d, held, strengths=(9.0, 3.0), partition_bytes=2000).collect()
    n, v = model.total, model.types
    want = []
    for r in rows:
        toks = [*lower(r["text"]), "<end>"]
        c = [model.count.get((w,), 0) for w in toks]
        want.append((str(r["doc_id"]), is_held(r), len(toks), sum(x > 0 for x in c), n, round(sum(math.log10((x + 1) / (n + v + 1)) for x in c), 6), round(model.score(toks[:-1]), 6)))
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in got) == sorted(want)
    every = [w for (w, *rest) in model.count if not rest and w != "<begin>"]
    for state in ((), ("<begin>",), ("w1",), ("w1", "w2")):
        assert sum(model.probability(state, w) for w in every) + model.probability(state, "unseen!") == pytest.approx(1)
    assert lm_scoring.score_texts(empty(spark), held).count() == 0


def test_names_are_sent_whole():
    rng = np.random.default_rng(1)
    for n, top in ((0, 9), (1, 9), (5, 2**64 - 1), (3000, 2**64 - 1), (40_000, 2**50)):
        keys = np.unique(rng.integers(0, top, n, dtype=np.uint64, endpoint=True))
        assert (lm_scoring.decode_names(lm_scoring.encode_names(keys)) == keys).all()
        counts = rng.integers(0, 600, n)
        assert (lm_scoring._unpack(lm_scoring._pack(counts)) == counts).all()


def test_lm_is_the_automaton_on_every_row_however_partitioned(spark):
    """All documents of sf0.01, in chunks and buckets of two sizes, against explicit states and arcs."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    lower = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words(t)]
    rows = [(r["doc_id"], lower(r["text"])) for r in d.collect()]
    model = lm_scoring.BackoffAutomaton([w for i, w in rows if zlib.crc32(str(i).encode()) % 7 != 2], (1024.0, 16.0))
    want = {i: model.score(w) for i, w in rows}
    found = []
    for n, size in ((2, 8 << 20), (64, 100_000)):
        old = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            got = lm_scoring.score_texts(d, held, partition_bytes=size).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", old)
        assert len(got) == len(rows)
        found.append({r["doc_id"]: (r["n_known"], r["base_score"], r["score"]) for r in got})
        assert all(abs(r["score"] - want[r["doc_id"]]) < 1e-6 for r in got)
    assert all(a == pytest.approx(found[1][i], abs=1e-9) for i, a in found[0].items())


def test_lm_beats_the_base_on_held_out_texts(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    r = lm_scoring.score_texts(d, held).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > 0.9 * r[1] and r[0] > r[1]


@pytest.mark.parametrize("hot", [False, True])
def test_shards(spark, hot):
    rng = random.Random(2)
    rows = ["same text " * 9] * 400 if hot else []
    rows += [" ".join(rng.choices("abcdef", k=rng.randint(1, 60))) for _ in range(800)] + [None, ""]
    d = docs(spark, rows)
    got = sharding.shard(d, n_shards=24, slot_bucket=8).collect()
    assert len(got) == d.count()
    size, slots = Counter(), {}
    for r in got:
        size[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    mean, largest = sum(size.values()) / 24, max(r["size"] for r in got)
    assert set(size) == set(range(24)) and all(abs(s - mean) <= 3 * largest for s in size.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] < len(rows):
            t = (rows[r["doc_id"]] or "").encode()
            assert (r["size"], r["text_crc32"]) == (len(t) + 8, zlib.crc32(t))
    assert sharding.shard(empty(spark)).count() == 0


@pytest.mark.parametrize(("n_shards", "hot"), [(24, False), (24, True), (7, False), (1, False), (60, True)])
def test_shards_are_those_of_a_plain_tree(spark, n_shards, hot):
    """The tree by sorting, on the same keys; slack 0, so cuts are exact."""
    rng = random.Random(n_shards)
    rows = ["same text " * 9] * 300 if hot else []
    d = docs(spark, rows + [" ".join(rng.choices("abcdef", k=rng.randint(1, 60))) for _ in range(500)] + [None, ""])
    keys, n = sharding.placed(d, n_shards, 0.0)
    rows = [r.asDict() for r in keys.collect()]
    assert n == len(rows) == d.count()
    dims = list(sharding.DIMENSIONS)
    by = lambda r, k: ((r[f"v_{dims[k]}"] << 20) + r["by_text"], r["by_row"])

    def split(part, first, leaves):
        if leaves == 1 or not part:
            assert all(r["node"] == first for r in part) or leaves > 1
            return
        spans = [max(r[f"v_{x}"] for r in part) - min(r[f"v_{x}"] for r in part) for x in dims]
        dim = spans.index(max(spans))
        part = sorted(part, key=lambda r: by(r, dim))
        goal, left = sum(r["size"] for r in part) * (leaves // 2) / leaves, leaves // 2
        at, sofar, groups = 0, 0, []
        while at < len(part):  # rows with one key are not divided
            end = at
            while end < len(part) and by(part[end], dim) == by(part[at], dim):
                end += 1
            groups.append((at, end, sofar, sofar + sum(r["size"] for r in part[at:end])))
            at, sofar = end, groups[-1][3]
        start, end, lo, hi = next(g for g in groups if g[3] >= goal)
        here = end if hi - goal < goal - lo else start
        assert {r["node"] < first + left for r in part[:here]} <= {True} and {r["node"] >= first + left for r in part[here:]} <= {True}
        split(part[:here], first, left)
        split(part[here:], first + left, leaves - left)

    split(rows, 0, n_shards)


def test_shards_by_target(spark):
    d = docs(spark)
    total = sum(len((r["text"] or "").encode()) + 8 for r in d.collect())
    got = sharding.shard(d, target_bytes=total // 5).collect()
    assert {r["shard"] for r in got} <= set(range(6)) and len(got) == d.count()
    clash = sharding.shard(d.withColumn("shard", F.lit("x")).withColumn("slot", F.lit("y")), n_shards=3)
    assert clash.columns == sharding.shard(d).columns and clash.count() == d.count()


def test_line_dedup(spark):
    shared = "\n".join(f"shared line number {i} of a long passage." for i in range(12))
    long = " ".join(f"word{i}" for i in range(60)) + "."
    rows = [f"own {i} start.\n{shared}\nown {i} end." for i in range(5)] + [f"a{i}.\n{long}\nb{i}." for i in range(3)] + [None, "", "\n\n", "solo"]
    d = docs(spark, rows)
    got = {r["doc_id"]: r for r in line_dedup.dedup(d).collect() if r["doc_id"] is not None}
    assert line_dedup.dedup(d).count() == d.count()
    assert got[0]["n_removed_lines"] == 0 and all(got[i]["n_removed_lines"] >= 6 for i in range(1, 5))
    assert got[5]["n_removed_lines"] == 0 and [got[i]["clean_text"] for i in (6, 7)] == ["a1.\nb1.", "a2.\nb2."]
    assert got[8]["clean_text"] is None and got[9]["clean_text"] == "" and got[10]["clean_text"] == "\n\n"
    for i, t in enumerate(rows):
        assert got[i]["removed_chars"] == len(t or "") - len(got[i]["clean_text"] or "")
        if t:
            assert all(f"own {i}" in got[i]["clean_text"] for _ in [0]) if i < 5 else True
    assert line_dedup.dedup(empty(spark)).count() == 0
    whole = spark.createDataFrame([(i, shared) for i in range(3)], "doc_id long, text string")
    assert line_dedup.deduped_documents(whole.withColumn("n_chars", F.length("text"))).count() == 1


PROSE = """Next, we compare the results.
Homeowners were told to leave.
Shareholders voted.
Shares of the company fell by a third.
Previously, the bridge was closed in winter.
Next to the mill there is a small garden.
Home is where the river bends.
Share the bread with your neighbours!
She baked a cookie.
The cookies were still warm.
It was a design in red.
He learned JavaScript at school.
You can subscribe to that view or not.
The mill was powered by water.
They had to sign in ink.
Please sign up before Monday.
The privacy policy of the state is old.
Login names are hard to remember.
Menus were printed on linen.
Previous owners had painted it green.
The court read the terms of service aloud.
A value of |x| is never negative, he said.
"Click here," said the teacher, "and watch."
Logins failed all night.""".split("\n")
MENUS = ["Next »", " home »", "a | b | c.", "» x » y.", "Login.|", "We use cookies, see our privacy policy.", "Sign up or log in.", "2020 Some Firm. All rights reserved.", "Menu | News.", "Lorem ipsum dolor sit amet."]


def test_lines_of_prose_and_of_menus(spark):
    d = spark.createDataFrame([(x,) for x in PROSE + MENUS], "line string")
    got = {r["line"]: r["kept"] for r in d.withColumn("kept", quality.line_kept(F.col("line"))).collect()}
    assert got == {x: x in PROSE for x in PROSE + MENUS}
    page = spark.createDataFrame([(1, "\n".join(PROSE)), (2, "\n".join(PROSE[:5] + ["Next » Home » Menu »"] * 3))], "doc_id long, text string")
    r = {x["doc_id"]: x for x in quality.assess(page).collect()}
    assert r[1]["kept"] and r[1]["clean_text"] == "\n".join(PROSE) and r[2]["clean_text"] == "\n".join(PROSE[:5])


def test_repeated_passages(spark):
    rng = random.Random(4)
    own = lambda k: [f"u{rng.randrange(10**9)}" for _ in range(k)]
    rows = []
    for lines in (1, 2, 3, 4, 5):
        passage = [own(120 // lines) for _ in range(lines)]
        for glue in ("\n", "\n", " ", "\t"):  # own lines twice, then inside a line, then with tabs
            body = ("\n" if glue == "\n" else " ").join(glue.join(x) if glue == "\t" else " ".join(x) for x in passage)
            rows.append(" ".join(own(9)) + ("\n" if glue == "\n" else " ") + body + ("\n" if glue == "\n" else " ") + " ".join(own(9)))
    least = own(50)
    rows += [" ".join([*own(3), *least, *own(3)]), "\n".join([*own(2), *least, *own(2)]), " ".join([*own(3), *least[:49], *own(3)])]
    rows += ["x " * 400, "", "\n\n", None, "solo"]
    for _ in range(80):  # passages after different words, some of them without an anchor of the first kind
        shared = own(52)
        rows += [" ".join([*own(40), *shared, *own(4)]) for _ in range(2)]
    d = spark.createDataFrame([(i, t, len(t or "")) for i, t in enumerate(rows)], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in line_dedup.deduped_documents(d).collect()}
    assert sorted(got) == list(range(len(rows)))
    seen = {}
    for i in sorted(got):
        w = words(got[i])
        for j in range(len(w) - 49):
            seen.setdefault(tuple(w[j : j + 50]), set()).add(i)
    assert not [v for v in seen.values() if len(v) > 1]
    for i, t in enumerate(rows[:20]):
        assert words(got[i]) == (words(t) if i % 4 == 0 else words(t)[:9] + words(t)[-9:])
        assert i % 4 == 0 or got[i].count("\n") == (1 if i % 4 == 1 else 0)
    assert words(got[21]) == words(rows[21])[:2] + words(rows[21])[-2:] and got[22] == rows[22]
    assert got[23].split() == ["x"] * 50 and [got[i] for i in (24, 25, 26, 27)] == ["", "\n\n", None, "solo"]
    assert line_dedup.deduped_documents(d.where("false")).count() == 0


def components(rows, n, percent):
    def grams(t):
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(t)]
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())

    sets = [(i, grams(t)) for i, t in rows]
    least = list(range(len(sets)))

    def find(i):
        while least[i] != i:
            i = least[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                least[max(x, y)] = min(x, y)
    groups = {}
    for k, (i, _) in enumerate(sets):
        groups.setdefault(find(k), []).append(i)
    low = {r: min([x for x in g if x is not None], default=None) for r, g in groups.items()}
    return sorted((str(i), len(s), str(low[find(k)])) for k, (i, s) in enumerate(sets))


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80), (2, 60)])
def test_jaccard(spark, n, percent):
    rng = random.Random(n)
    base = [f"b{i}" for i in range(70)]
    family = []
    for _ in range(60):  # near copies of one text, some closer than others
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(40)}"
        family.append(" ".join(w))
    d = docs(spark, texts() + family)
    got = jaccard_join.similar(d, n=n, percent=percent, partition_bytes=3000).collect()
    want = components([(r["doc_id"], r["text"]) for r in d.collect()], n, percent)
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == want
    left = jaccard_join.deduplicated(d, n=n, percent=percent)
    alone = sum(r["n_shingles"] == 0 for r in got)
    assert left.columns == d.columns and left.count() == len({r["component_id"] for r in got if r["n_shingles"]}) + alone
    assert jaccard_join.similar(empty(spark)).count() == 0


def test_chat(spark):
    rows = [
        (1, 1, "assistant", "b"), (1, 0, "user", "a\\<|end|>"), (1, 2, "assistant", "[INST] c </s>"), (2, 0, None, None), (2, 0, None, None),
        (None, 5, "user", "x"), (3, None, "user<|text|>", "\\"), (3, 1, "assistant", ""), (4, 0, "user", "\\\\<|sep|>\n$1"),
    ]
    turns = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    out = chat_format.format_conversations(turns)
    read = out.withColumn("turns", chat_format.read_back(F.col("formatted"))).collect()
    want = {}
    for c, t, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in read} == want
    one = next(r for r in read if r["conv_id"] == 1)
    assert one["formatted"].count("<|start|>") == 2 and one["formatted"].count("<|sep|>") == 1
    for r in read:
        at, marked = 0, []
        for run in r["loss_runs"]:
            if run["loss"]:
                marked.append(r["formatted"][at : at + run["chars"]])
            at += run["chars"]
        assert at == len(r["formatted"])
        assert [re.sub(r"(?s)\\(.)", r"\1", m) for m in marked] == [t for role, t in want[r["conv_id"]] if role == "assistant"]
    told = chat_format.digests(out)
    assert told.where("mask_chars <> formatted_chars").count() == 0
    by_conv = {r["conv_id"]: r for r in told.collect()}
    for c, turns_ in want.items():
        learned = "".join(t for role, t in turns_ if role == "assistant")
        assert (by_conv[c]["loss_chars"], by_conv[c]["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    # the digests are those of the mask, not of the roles: masks that are moved, cut or turned around give others
    moved = lambda change: out.withColumn("loss_runs", F.transform("loss_runs", change))
    for change in (
        lambda r: F.struct((r["start"] + 1).alias("start"), r["chars"].alias("chars"), r["loss"].alias("loss")),
        lambda r: F.struct(r["start"].alias("start"), (r["chars"] - 1).alias("chars"), r["loss"].alias("loss")),
        lambda r: F.struct(r["start"].alias("start"), r["chars"].alias("chars"), (~r["loss"]).alias("loss")),
    ):
        assert {r["conv_id"]: r["loss_sha256"] for r in chat_format.digests(moved(change)).collect()}[1] != by_conv[1]["loss_sha256"]
    wide = spark.createDataFrame([(0, 0, "user", "ä\U0001f600é"), (0, 1, "assistant", "\U0001f600\\ ok"), (0, 2, "assistant", "ß")], "conv_id long, turn long, role string, text string")
    one = chat_format.digests(chat_format.format_conversations(wide)).first()
    assert one["loss_sha256"] == hashlib.sha256("\U0001f600\\ okß".encode()).hexdigest() and one["loss_chars"] == 6
    long = spark.createDataFrame([(0, i, "assistant" if i % 2 else "user", f"text {i} " * 9) for i in range(3000)], "conv_id long, turn long, role string, text string")
    one = chat_format.digests(chat_format.format_conversations(long)).first()
    assert one["loss_sha256"] == hashlib.sha256("".join(f"text {i} " * 9 for i in range(1, 3000, 2)).encode()).hexdigest()
    assert chat_format.format_conversations(turns.where("false")).count() == 0


def test_urls(spark):
    entries = [("a.com", 10, "add", "x"), ("a.com", 20, "remove", "x"), ("a.com", 20, "add", "x"), ("sub.b.org", 5, "add", "y"), ("sub.b.org", 7, "add", "z"), ("sub.b.org", 9, "remove", "y"), (None, 1, "add", "n")]
    e = spark.createDataFrame(entries, "domain string, at long, action string, reason string")
    pages = [(1, "https://www.A.com:80/x", 9), (2, "https://x.a.com/", 10), (3, "http://a.com", 20), (4, "http://u@deep.sub.b.org/?q", 8), (5, "http://b.org/", 8), (6, None, 8), (7, "not a url", 8), (8, "http://sub.b.org/", None), (9, "http://sub.b.org", 9)]
    c = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, fetched_at long, reason string")
    got = {r["page_id"]: (r["blocked"], r["blocked_by"]) for r in url_filters.evaluate(c, e).collect()}
    no = (False, None)
    assert got == {1: no, 2: (True, "a.com"), 3: no, 4: (True, "sub.b.org"), 5: no, 6: no, 7: no, 8: no, 9: no}
    assert url_filters.evaluate(c, e.where("false")).where("blocked").count() == 0 and url_filters.evaluate(c.where("false"), e).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)]
    rows += [(300 + i, [0.5] * 8) for i in range(12)] + [(400, None), (401, []), (402, [float("nan")] * 8), (403, [None] * 8), (404, [float("inf")] * 8), (405, [1.0, 2.0]), (None, [1.0] * 8)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit("clash"))
    got = topk_search.top_k(d, F.col("vec_id") % 50 == 0, k=5, shard_rows=64).collect()
    good = {i: [math.floor(256 * x) for x in v] + [0] * (8 - len(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q in (i for i in good if i % 50 == 0):
        scored = sorted((-sum(a * b for a, b in zip(good[q], v, strict=True)), i) for i, v in good.items() if i != q)[:5]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == sorted(want)
    assert topk_search.top_k(d.where("false"), F.col("vec_id") % 50 == 0).count() == 0
    few = topk_search.top_k(d.where("vec_id < 3"), F.col("vec_id") % 50 == 0)
    assert few.count() == 2


def test_top_k_stops_on_proof_and_only_then():
    rng = np.random.default_rng(7)
    ids = np.arange(4000)
    sparse = np.where(rng.random((4000, 32)) < 0.05, rng.integers(-400, 400, (4000, 32)), 0)
    sparse[:6] = 5 * np.sign(sparse[6]) * 300 + 900  # some candidates stand out, others can't reach them
    flat = rng.integers(-300, 300, (4000, 32))
    for vectors, early in ((sparse, True), (flat, False)):
        block = topk_search.Block(ids, vectors)
        every = sum(len(x) for _, x in block.levels)
        queries = np.concatenate([np.full((1, 32), 200), rng.integers(-300, 300, (5, 32))])
        queries = queries[:1] if early else queries
        can, read = block.search(queries.astype(float), ids[:, None] == np.full(len(queries), -1), np.full(len(queries), -np.inf), 5)
        assert (read < every) == early or not early
        for q, at in zip(queries, can, strict=True):
            scores = vectors @ q
            assert set(np.lexsort((ids, -scores))[:5]) <= set(at.tolist())
    # the bound after every level holds for every candidate
    block = topk_search.Block(ids, flat)
    sums = np.zeros(4000)
    q = rng.integers(-300, 300, 32).astype(float)
    for (impact, segments), lacking in zip(block.levels, block.lacking[1:], strict=True):
        for d, rows in segments:
            sums[rows] += impact * q[d]
        assert (np.abs(flat @ q - sums) <= np.sqrt((q**2).sum()) * lacking + 1e-6).all()


def test_top_k_of_repeated_ids_and_of_scores_beyond_64_bits(spark):
    rows = [(50, [1.0, 2.0])] * 300 + [(7, [1.0, 2.0])] * 3 + [(8, [3.0])] + [(100, [1e15, 1e15]), (101, [1e15, -1.0]), (102, [-1e15, -1e15])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk_search.top_k(d, F.col("vec_id") % 50 == 0, k=5, shard_rows=16).collect()]
    v = lambda i: [int(256 * x) for x in dict(rows)[i]] + [0]
    hold = lambda x: max(-(2**63), min(2**63 - 1, x))
    want = []
    for q in (50, 100):
        scored = sorted((-hold(sum(a * b for a, b in zip(v(q), v(i)))), i) for i, _ in rows if i != q)[:5]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    assert sorted(got) == sorted(want)
