"""The whole pipeline against a plain version of its five stages, on a small table made by rule."""

import hashlib
import math
import random
import re

import pytest

import corpus_pipeline
from lobspark.llm import sentencepiece_codec as sc

sentencepiece = pytest.importorskip("sentencepiece")
SPLIT = re.compile(r"[\x20\x09-\x0D]+")
ENDS = ".!?:;…。！？\"'”’»)]"
PHRASES = ["cookies", "cookie policy", "cookie settings", "javascript", "privacy policy", "terms of use", "terms of service", "click here", "sign up", "sign in", "log in", "subscribe", "newsletter", "powered by"]


def words(t):
    return [w for w in SPLIT.split(t) if w]


def line_stays(line):
    bare = line.strip(" \t\n\x0b\x0c\r")
    low = bare.lower()
    if not bare:
        return True
    if len(bare) < 200:
        dividers = sum(low[i] in "|»" and low[i - 1 : i] in ("", " ") and low[i + 1 : i + 2] in ("", " ") for i in range(len(low)))
        menu = re.split(r"[|>»]", low)[0].strip() in ("home", "menu", "next", "previous", "back to top", "share", "login", "log in")
        named = sum(re.search(rf"\b{p}\b", low) is not None for p in PHRASES)
        if dividers > 1 or menu or named > 1 or "all rights reserved" in low or "lorem ipsum" in low:
            return False
    return bare[-1] in ENDS


def quality(rows):
    out = []
    for i, text, source in rows:
        text = text or ""
        w, lines = words(text), text.split("\n")
        stay = [x for x in lines if line_stays(x)]
        seen = {}
        for k in range(len(w) - 7):
            seen.setdefault(tuple(w[k : k + 8]), []).append(k)
        repeated = {j for at in seen.values() if len(at) > 1 for k in at for j in range(k, k + 8)}
        chars, left = sum(map(len, lines)), sum(map(len, stay))
        if len(w) >= 20 and 100 * len(repeated) <= 30 * len(w) and 100 * (chars - left) <= 50 * chars:
            out.append((i, "\n".join(stay), source))
    return out


def chunks(text):
    lines = text.split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    long = [x.count(" ") >= 49 for x in lines]
    starts = [j for j in range(len(lines)) if j == 0 or ((h[j - 2] if j > 1 else 0) * 31 + h[j - 1]) % 3 == 0 or long[j - 1] or long[j]]
    return [lines[a:b] for a, b in zip(starts, [*starts[1:], len(lines)], strict=True)]


def without_words(text, gone):
    w, gaps = words(text), re.split(r"[^\x20\x09-\x0D]+", text)
    out, k = gaps[0], 0
    while k < len(w):
        if k not in gone:
            out += w[k] + (gaps[k + 1] if k + 1 < len(w) and k + 1 not in gone else "")
            k += 1
            continue
        a = k
        while k < len(w) and k in gone:
            k += 1
        out += "" if a == 0 or k == len(w) else gaps[k] if "\n" in gaps[k] else gaps[a]
    return out + gaps[len(w)]


def line_dedup(rows):
    rows, first, kept = sorted(rows), {}, []
    for i, text, _ in rows:
        for j, c in enumerate(chunks(text)):
            if sum(bool(words(x)) for x in c) >= 2 or c[0].count(" ") >= 49:
                first.setdefault(("chunk", *c), (i, j))
        w = words(text)
        for j in range(len(w) - 49):
            first.setdefault(("words", *w[j : j + 50]), (i, j))
    for i, text, source in rows:
        cs, w = chunks(text), words(text)
        gone = {j for j, c in enumerate(cs) if first.get(("chunk", *c), (i, j)) != (i, j)}
        past = set()
        for j in range(len(w) - 49):
            at = first["words", *w[j : j + 50]]
            if at[0] != i or j >= at[1] + 50:
                past |= set(range(j, j + 50))
        clean = text
        if past:
            ends = [0]
            for c in cs:
                ends.append(ends[-1] + len(words("\n".join(c))))
            clean = without_words(text, past | {k for j in gone for k in range(ends[j], ends[j + 1])})
        elif gone:
            clean = "\n".join(x for j, c in enumerate(cs) if j not in gone for x in c)
        if clean == text or words(clean):
            kept.append((i, clean, source))
    return kept


def near_duplicates(rows):
    rows, keep = sorted(rows), []
    sets = []
    for _, text, _ in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(text)]
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((group[a], group[b]))
                group = [x if g == y else g for g in group]
    for a, row in enumerate(rows):
        if not sets[a] or group.index(group[a]) == a:
            keep.append(row)
    return keep


def mix(spark, rows):
    half_up = lambda x: math.floor(x + 0.5)
    draws = {(r["i"], r["t"]): r["d"] for r in spark.createDataFrame([(i, t) for i, t, _ in rows], "i long, t string").selectExpr("i", "t", "xxhash64(7, i, t) as d").collect()}
    of = {}
    for i, t, s in rows:
        of.setdefault(s, []).append((draws[i, t], i, len(words(t)), t))
    order = sorted((s for s in of if s is not None)) + [None] * (None in of)
    size = {s: sum(x[2] for x in of[s]) for s in order}
    weight, held, total = {s: 1 + k % 3 for k, s in enumerate(order)}, set(), sum(size.values())
    while True:
        level = (total - sum(3 * size[s] for s in held)) / sum(weight[s] for s in order if s not in held)
        over = {s for s in order if s not in held and weight[s] * level > 3 * size[s]}
        if not over:
            break
        held |= over
    target = {s: 3 * size[s] if s in held else weight[s] * level for s in order}
    seats = dict.fromkeys(order, 0)
    for _ in range(half_up(sum(target.values()) / 16)):
        best = max(order, key=lambda s: (target[s] / (2 * seats[s] + 1), -order.index(s)))
        seats[best] += 1
    out = []
    for no, s in enumerate(order):
        assert size[s] <= 65_536  # one shard each
        blocks = max(1, half_up(size[s] / 16))
        quota = min(seats[s], 3 * blocks)
        times, run = divmod(quota, blocks)
        start = spark.sql(f"select pmod(xxhash64(7, {no}, 0L), {blocks}L)").first()[0]
        edge = lambda k: k * size[s] // blocks  # noqa: E731, B023
        taken = set(range(edge(start), edge(min(start + run, blocks)))) | set(range(0, edge(max(start + run - blocks, 0))))
        at = 0
        for _, i, n, text in sorted(of[s]):
            some = [w for k, w in enumerate(words(text)) if at + k in taken]
            at += n
            out += [(i, text)] * (times + (len(some) == n))
            if 0 < len(some) < n:
                head = [w for k, w in enumerate(words(text)) if at - n + k in taken and at - n + k < edge(max(start + run - blocks, 0))]
                rest = [w for k, w in enumerate(words(text)) if at - n + k in taken and at - n + k >= edge(max(start + run - blocks, 0))]
                out.append((i, " ".join(head + rest)))
    return out


def made(seed=11):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijklmnopqrstuvwxyz") + rng.choice(["ora", "ent", "ilu", "ast", "um"]) + str(rng.randrange(400))
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    para = lambda k: "\n".join(sentence(rng.randint(4, 14)) for _ in range(k))
    own = [para(rng.randint(3, 12)) for _ in range(60)]
    passage, long = para(6), sentence(70)
    texts = list(own)
    texts += [own[0], own[0], own[1] + "\n" + para(1)]  # exact copies and one with more
    for t in own[2:8]:  # near copies
        w = t.split(" ")
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [f"{para(3)}\n{passage}\n{para(2)}" for _ in range(5)] + [f"{para(2)} {long} {para(2)}" for _ in range(4)]
    texts += ["Home | News | About |\nlogin\nWe use cookies, see our privacy policy.\n" * 8 + sentence(20)]
    texts += [para(5) + "\nNext »\n" + para(2), sentence(9), "", None, "no end of line here\n" * 12, "again and again and again we say it so. " * 20]
    texts += [sentence(60) + "\n" + "Next, we compare the results.", " lead  and\ttabs " + para(4)]
    return [(i, t, None if i % 13 == 0 else f"s{i % 4}") for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [11, 12])
def test_pipeline_is_the_plain_one(spark, tmp_path, seed):
    rows = made(seed)
    d = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    d.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    stages = [quality(rows)]
    stages.append(line_dedup(stages[-1]))
    stages.append(near_duplicates(stages[-1]))
    got = d
    for (name, stage), want in zip(corpus_pipeline.STAGES, stages, strict=False):
        got = stage(spark, got, str(tmp_path))
        assert sorted((r["doc_id"], r["text"], str(r["source"])) for r in got.collect()) == sorted((i, t, str(s)) for i, t, s in want), name
    assert len(rows) > len(stages[0]) > len(stages[1]) >= len(stages[2]) > 40 and stages[0] != stages[1]
    library = sentencepiece.SentencePieceProcessor(model_proto=sc.read_model(sc.MODEL))
    want = sorted((i, library.encode(t)) for i, t in mix(spark, stages[-1]))
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["ids"]) for r in found) == want and all(r["exact"] and r["n_tokens"] == len(r["ids"]) for r in found)


def test_stages_on_nulls_repeats_and_empty_tables(spark, tmp_path):
    """Nulls in every column, repeated rows and no rows at all: every stage runs, and counts rows as its docstring says."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    long = ". ".join(f"Word{i} and more of it" for i in range(900)) + "."
    odd = [(None, None, None, None, None), (1, None, "en", "a", 3), (None, long, None, None, None), (None, long, None, None, None), (2, "", "en", "a", 0), (3, long + " Tail.", "en", None, 5)]
    for rows in (odd, []):
        d = spark.createDataFrame(rows, schema)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, d, str(tmp_path))
            n = out.count()
            assert n <= 3 * len(rows) and (rows or n == 0)
            assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == d.columns
            stage(spark, d.withColumn("__key", d["text"]).withColumn("kept", d["text"]).select(*d.columns), str(tmp_path)).count()
