"""Each operator in Spark: odd inputs with defined results, and brute force over the smallest tables."""

import hashlib
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import DATA, duck, rows
from partgraph.llm import chat, decontaminate, licenses, line_dedup, matroska, mix, ngram_join, quality, secrets, suffix_dedup
from partgraph.llm.queries import ORACLE_SQL, QUERIES

SF = f"{DATA}/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, n string, node long, k string"
LONG = "x".join(f"word{i} " for i in range(4000))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty, blank and long texts, repeated rows, ties, clashing names."""
    texts = [(1, None), (2, ""), (3, " \n \n"), (4, LONG), (5, LONG), (5, LONG), (None, "some words of no id"), (None, None), (7, "é"), (-3, LONG + " y")]
    return spark.createDataFrame([(i, t, None, None if i == 7 else "a", None, "s", "n", 0, "k") for i, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_query_equals_its_sql(spark, name):
    assert rows(QUERIES[name](spark, SF)) == duck("sf0.001", ORACLE_SQL[name])


def test_op1(spark, docs, odd, none):
    got = {r["doc_id"]: r for r in QUERIES["op1_license_scan"](spark, SF).collect()}
    assert got.keys() == docs.keys()
    for i, text in docs.items():
        words = licenses.words_of(text)
        hits = [(k, label) for p, label in licenses.BASE.items() for q in [p.split()] for k in range(len(words)) if words[k : k + len(q)] == q]
        places = [k for k, _ in hits]
        want = (len(words), len(hits), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in hits})))
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == want
        assert set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1
    assert licenses.scan_licenses(odd).count() == 10 and licenses.scan_licenses(none).count() == 0


def test_op2(odd, none):
    made = mix.mix(odd).collect()
    assert len(made) == 10 and all(0 <= r["copies"] <= 3 for r in made)
    assert {r["n"] for r in made} == {"n"} and mix.mix(none).count() == 0
    assert mix.emit(mix.mix(odd)).count() == sum(r["copies"] for r in made)


def test_op2_targets(spark):
    s = spark.createDataFrame([("a", 10), ("b", 1000), (None, 100), ("c", 0)], "source string, source_size long")
    t = {r["source"]: r["target"] for r in mix.source_targets(s).collect()}
    # a (weight 5) stops at 30, c (weight 1) at 0, null (weight 5) at 300; b takes the rest.
    assert t == {"a": 30.0, "c": 0.0, None: 300.0, "b": 780.0}


def test_op3(spark, docs, odd, none):
    for r in QUERIES["op3_media_columns"](spark, SF).collect():
        raw = docs[r["doc_id"]].encode()
        whole = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(whole))
        assert r["payload_sha256"] == hashlib.sha256(whole).hexdigest() and r["tail_crc32"] == zlib.crc32(whole[-32:])
    assert matroska.media_digests(odd).count() == 10 and matroska.media_digests(none).count() == 0


def test_op3_packets(spark):
    media = spark.createDataFrame([(1, bytearray(matroska.mux(b"a" * 1152))), (2, None), (3, bytearray(b"zz"))], "id long, media binary")
    got = matroska.packets(media, "id", "media").orderBy("id", "packet").collect()
    assert [(r["id"], r["size"]) for r in got] == [(1, 576), (1, 576), (2, None), (3, None)] and got[-1]["error"]


def test_op4(spark):
    turns = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", None), (None, None, None, None), (2, 0, "assistant", "<|im_end|>"), (2, 0, "assistant", "<|im_end|>")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    one = {r["conv_id"]: r for r in chat.repair(df).collect()}
    assert chat.to_messages(one[1]["text"]) == [("user", "a\nb"), ("assistant", "")] and one[1]["cost"] == 1
    assert one.keys() == {1, 2, None} and one[2]["turns_in"] == 2
    times = spark.createDataFrame([(1, 10**9 + 9000 * i, r, "t") for i, r in enumerate(["user", "assistant", "user"])], df.schema)
    assert [(r["part"], r["turns_in"]) for r in chat.repair(times).collect()] == [(0, 3)]
    nulls = spark.createDataFrame([(None, None, "user", "t")] * 7 + [(4, 1, "user", "t")], df.schema)
    many = sorted((r["conv_id"] or 0, r["part"], r["turns_in"]) for r in chat.repair(nulls, part=3).collect())
    assert many == [(0, 0, 3), (0, 1, 3), (0, 2, 1), (4, 0, 1)]
    parts = chat.repair(df, part=1).groupBy("conv_id").agg(F.sum("cost").alias("cost")).collect()
    assert {r["conv_id"]: r["cost"] for r in parts} == {k: r["cost"] for k, r in one.items()}
    assert chat.repair(df.limit(0)).count() == 0


def test_op5(odd, none, spark):
    d = line_dedup.dedup_lines(odd, prefix="p_").collect()
    assert len(d) == 10 and {r["p_n_removed"] for r in d} == {0}  # one line each, or blank
    lines = spark.createDataFrame([(1, "a\nb\nc"), (2, "x\na\nb\nc"), (3, "b\nc\nb\nc\nb"), (4, "a\nb")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(lines).collect()}
    left = {i: r["text"] for i, r in got.items()}
    assert left == {1: "a\nb\nc", 2: "x", 3: "", 4: ""}
    assert [(got[3][c]) for c in ("n_removed", "n_runs", "longest_run")] == [5, 2, 3]  # b c, and b c b over itself
    deep = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(lines, 3).collect()}
    assert deep == {1: "a\nb\nc", 2: "x", 3: "b\nc", 4: "a\nb"}
    assert line_dedup.without_copied_lines(lines).count() == len([t for t in left.values() if t])
    assert line_dedup.dedup_lines(none).count() == 0


def brute_lines(texts, least, words):
    """{doc_id: (left, n_removed, n_runs, longest)} by comparing every two places."""
    docs = sorted((i, t.split("\n")) for i, t in texts)
    out = {}
    for n, (i, lines) in enumerate(docs):
        length = []
        for p in range(len(lines)):
            best = 0
            for j, other in docs[: n + 1]:
                for q in range(p if j == i else len(other)):
                    k = 0
                    while p + k < len(lines) and q + k < len(other) and lines[p + k] == other[q + k]:
                        k += 1
                    best = max(best, k)
            long = best >= least and any(x.strip(" ") for x in lines[p : p + best])
            length.append(best if long else 1 if best and len(lines[p].split()) >= words else 0)
        gone = {x for p, k in enumerate(length) for x in range(p, p + k)}
        runs = [p for p, k in enumerate(length) if k and p + k > max([x + n for x, n in enumerate(length[:p]) if n], default=0)]
        out[i] = ("\n".join(x for p, x in enumerate(lines) if p not in gone), len(gone), len(runs), max(length))
    return out


def test_op5_brute_force(spark):
    rng = random.Random(8)
    body = [[rng.choice(["", "a", "b", "c d e f", "g"]) for _ in range(rng.randint(1, 12))] for _ in range(14)]
    body += [body[3] + ["z"], body[4], body[5][1:], ["y"] + body[5], body[4]]
    texts = [(i, "\n".join(x)) for i, x in enumerate(body)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    for least in (2, 4):
        got = {r["doc_id"]: (r["text"], r["n_removed"], r["n_runs"], r["longest_run"]) for r in line_dedup.dedup_lines(docs, least, passage_words=4).collect()}
        assert got == brute_lines(texts, least, 4)


def test_reserved_names(spark):
    """Columns named like those that the operators use on the way stay."""
    names = "runs info mask key k _k _d src slot below ahead rank copy stats d pos join_key".split()
    schema = "doc_id long, text string, source string, " + ", ".join(f"`{n}` long" for n in names)
    docs = spark.createDataFrame([(i, f"one two three {i}\nfour five six", "s", *range(len(names))) for i in range(3)], schema)
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int")
    items = spark.createDataFrame([(1, "three 2")], "item_id long, text string")
    made = [line_dedup.without_copied_lines(docs), mix.emit(mix.mix(docs)), ngram_join.keep_one(docs), decontaminate.decontaminate(docs, items), quality.keep_good(docs, labels)]
    for frame in made:
        assert set(docs.columns) <= set(frame.columns)
        assert all(tuple(r[n] for n in names) == tuple(range(len(names))) for r in frame.collect())
    assert {r["doc_id"] for r in made[3].collect()} == {0, 1}


def test_op5_passages(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(50)) for c in "ab")
    short = " ".join(f"s{i}" for i in range(49))
    texts = [(1, f"x\n{a}\ny\n{short}"), (2, f"z\n{a}\nq\n{short}\nr"), (3, b), (4, b), (5, f"{a}\nw\n{a}\n{short}"), (6, f"{b}\nz\n{a}\nq\nt")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs, passage_words=50).collect()}
    left = {1: texts[0][1], 2: f"z\nq\n{short}\nr", 3: b, 4: "", 5: f"w\n{short}", 6: "t"}
    assert {i: r["text"] for i, r in got.items()} == left
    assert [(r["n_removed"], r["n_runs"], r["longest_run"]) for _, r in sorted(got.items())] == [(0, 0, 0), (1, 1, 1), (0, 0, 0), (1, 1, 1), (2, 2, 1), (4, 2, 3)]
    import corpus_pipeline as p

    assert {r["doc_id"]: r["text"] for r in p.line_dedup(spark, docs, SF).collect()} == {i: t for i, t in left.items() if t}


def test_op6(spark, docs, odd, none):
    got = QUERIES["op6_quality"](spark, SF).collect()
    assert {r["doc_id"] for r in got} == docs.keys() and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in got)
    labels = spark.createDataFrame([(1, 1), (1, None), (99, 0)], "doc_id long, quality int")
    of = quality.stats(odd)
    assert quality.scored(of, quality.fit(of, labels)).count() == 10
    unlabelled = quality.scored(of, quality.fit(of, labels.limit(0))).collect()
    assert all(abs(r["score"] - 0.5) < 0.001 and not r["predicted"] for r in unlabelled)
    assert quality.keep_good(none, labels).count() == 0


def test_op6_fit_is_ridge(spark):
    """The distributed fit against one solve of the same normal equations on the driver."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, len(quality.STATS))).astype(np.float32)
    y = (x[:, 0] + x[:, 3] > 0).astype(int)
    of = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, stats array<float>").repartition(5)
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "doc_id long, quality int")
    model = quality.fit(of, labels)
    part = np.array([zlib.crc32(str(i).encode()) % 4 for i in range(300)])
    learns = part != quality.HELD_OUT
    a = x[learns].astype(float)
    assert np.allclose(model.mean, a.mean(0)) and np.allclose(model.scale, a.std(0))
    own = learns & (part != quality.CALIBRATES)
    z = model.features(x[own].astype(float))
    ridge = quality.RIDGE * learns.sum() / quality.FEATURES * np.eye(z.shape[1])
    assert np.allclose(model.weights, np.linalg.solve(z.T @ z + ridge, z.T @ y[own]), atol=1e-6)
    raw = model.raw(x[part == quality.CALIBRATES].astype(float))
    bins = np.clip((raw - quality.LOW) / (quality.HIGH - quality.LOW) * quality.BINS, 0, quality.BINS - 1).astype(int)
    known = np.unique(bins)
    sums = [y[part == quality.CALIBRATES][bins == b].sum() for b in known]
    assert np.allclose(model.curve[1], quality.isotonic(np.array(sums, float), np.array([(bins == b).sum() for b in known], float)))


def test_op6_held_out(spark):
    path = f"{DATA}/sf0.1"
    got = {r["doc_id"]: r for r in QUERIES["op6_quality"](spark, path).collect()}
    marks = [(got[r["doc_id"]], r["quality"]) for r in spark.read.parquet(f"{path}/labels.parquet").collect()]
    held = [(r["predicted"], q) for r, q in marks if r["held_out"]]
    assert np.mean([p == q for p, q in held]) > 0.98


def test_op7(spark, docs, odd, none):
    assign = r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for r in QUERIES["op7_secret_scan"](spark, SF).collect():
        text = docs[r["doc_id"]]
        spans = [(m.start(), 0, m.end()) for m in re.finditer(assign, text) if len(m[2]) >= 6]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]{16,}", text)]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]{24,}", text)]
        said = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert secrets.scan_secrets(odd).count() == 10 and secrets.scan_secrets(none).count() == 0


def test_op7_gates(spark):
    key, short, wide = "qXvZkWpJrTgBzLnHcYfD", "q7XvZ2kW9pJrT4gB", "a9" * 8 + "Zq7XvK2pWm" * 3
    texts = [f"is {key} here", f"is {short} here", f"commit: {key}", f"md5: {wide}", "sha1: Lve95gjOVATpfV8EL5X4nxwjKHE="]
    docs = spark.createDataFrame(list(enumerate([*texts, "Donaudampfschifffahrt unbelievably"])), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in secrets.scan_secrets(docs).collect()}
    assert got == {0: "token:3:23", 1: "token:3:19", 2: "token:8:28", 3: f"token:5:{5 + len(wide)}", 4: "", 5: ""}


@pytest.mark.parametrize("most", [decontaminate.MOST_BROADCAST, 0])
def test_op8(spark, odd, none, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "MOST_BROADCAST", most)  # 0: items are shuffled, too
    items = spark.createDataFrame([(1, "xword1 xword2 xword3 xword4 xword5 xword6"), (2, "a b"), (None, None), (3, "q w e r t y u")], "item_id long, text string")
    found = sorted((r["doc_id"], r["item_id"]) for r in decontaminate.find_items(odd, items).collect())
    assert found == [(-3, 1), (4, 1), (5, 1)]
    short = spark.createDataFrame([(7, "OF no"), (8, "é"), (9, "no of")], "item_id long, text string")
    both = decontaminate.find_items(odd, items.unionByName(short)).collect()
    assert sorted((r["doc_id"] or 0, r["item_id"]) for r in both) == [(-3, 1), (0, 7), (4, 1), (5, 1), (7, 8)]
    assert decontaminate.decontaminate(odd, items).count() == 6
    assert decontaminate.find_items(none, items).count() == 0 and decontaminate.decontaminate(odd, items.limit(0)).count() == 10


def brute_bytes(texts, length=200):
    seen = {}
    raw = [t.encode() for t in texts]
    for b in raw:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] = seen.get(b[i : i + length], 0) + 1
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        left = bytes(np.frombuffer(b, np.uint8)[~gone])
        yield len(b), int(gone.sum()), int((gone & ~np.append(False, gone[:-1])).sum()), hashlib.sha256(left).hexdigest()


@pytest.mark.parametrize("shard", [suffix_dedup.SHARD, 700])
def test_op9(spark, docs, odd, none, monkeypatch, shard):
    monkeypatch.setattr(suffix_dedup, "SHARD", shard)  # 700: many shards, and most grams are hot
    monkeypatch.setattr(suffix_dedup, "HOT", 4 * shard if shard > 700 else shard)
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op9_suffix_dedup"](spark, SF).collect()}
    assert got == dict(zip(docs, brute_bytes(docs.values())))
    if shard == 700:
        out = sorted(tuple(r) for r in suffix_dedup.dedup_bytes(odd).collect() if r["doc_id"] is not None)
        texts = [(1, ""), (2, ""), (3, " \n \n"), (4, LONG), (5, LONG), (5, LONG), (7, "é"), (-3, LONG + " y")]
        assert out == sorted((i, *w) for (i, _), w in zip(texts, brute_bytes([t for _, t in texts])))
        assert suffix_dedup.dedup_bytes(none).count() == 0


def test_op10(odd, none, monkeypatch):
    out = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in ngram_join.components(odd).collect())
    n = len(LONG.split()) - 3
    want = [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, n, -3), (5, n, -3), (5, n, -3), (0, 2, 0), (0, 0, 0), (7, 1, 7), (-3, n + 1, -3)]
    assert out == sorted(want)
    assert ngram_join.keep_one(odd).count() == 7 and ngram_join.components(none).count() == 0
    monkeypatch.setattr(ngram_join, "BLOCK", 4000)  # every component in many trees
    again = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in ngram_join.components(odd).collect())
    assert again == out


def test_stages_against_brute_force(spark):
    """Stages 2 to 5 on a small table, each on what the brute-force version of the one before keeps."""
    import corpus_pipeline as p

    rng = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(rng.randint(60, 90))] for _ in range(12)]
    item = " ".join(f"item{i}" for i in range(20))
    passage = " ".join(f"p{i}" for i in range(55))
    texts = [" ".join(b) for b in base] + [" ".join(["new", *base[0][1:]]), " ".join([*base[1], "end"]), " ".join(base[2])]
    texts += [f"{texts[3]} {item} rest", f"a\n{passage}\nb", f"c\n{passage}\nd", "x y\nz", "q\nx y\nz"]
    rows_ = [(i, t, "st"[i % 2]) for i, t in enumerate(texts)]
    frame = lambda r: spark.createDataFrame(r, "doc_id long, text string, source string")
    lines = {i: t for i, (t, *_) in brute_lines([(i, t) for i, t, _ in rows_], 2, 50).items()}
    lines = [(i, lines[i], s) for i, _, s in rows_ if lines[i] or not texts[i]]
    assert sorted(tuple(r) for r in p.line_dedup(spark, frame(rows_), SF).collect()) == lines
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for _, t, _ in lines for w in [t.split()]]
    root = list(range(len(lines)))
    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root = [root[b] if r == root[a] else r for r in root]
    seen, near = set(), []
    for r, row in zip(root, lines):
        if r not in seen:
            near.append(row)
        seen.add(r)
    assert len(near) < len(lines)
    assert sorted(tuple(r) for r in p.near_duplicates(spark, frame(lines), SF).collect()) == near
    clean = [r for r in near if item not in r[1]]
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert len(clean) == len(near) - 1
    assert sorted(tuple(r) for r in decontaminate.decontaminate(frame(near), items).collect()) == clean
    out = p.mixing(spark, frame(clean), SF).collect()
    size = {i: len(t.split()) for i, t, _ in clean}
    both = {s: sum(size[i] for i, _, x in clean if x == s) for s in "st"}
    goal = {"s": min(3 * both["s"], sum(both.values()) * 5 / 7)}
    goal["t"] = min(3 * both["t"], sum(both.values()) - goal["s"])
    for s in "st":
        assert abs(sum(size[r["doc_id"]] for r in out if r["source"] == s) - goal[s]) <= 2 * max(size.values())
    assert all(len([r for r in out if r["doc_id"] == i]) <= 3 for i in size)


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in p.STAGES][0] == "quality classifier" and len(p.STAGES) == 5
    out = p.run(spark, SF)
    kept = {r["doc_id"] for r in out.select("doc_id").collect()}
    assert kept and kept < {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert not {r["doc_id"] for r in QUERIES["op8_decontamination"](spark, SF).collect()} & kept


def test_components_are_the_same_however_many_tasks_see_the_copies(spark):
    from partgraph.llm.ngram_join import components

    base = " ".join(f"w{i}" for i in range(60))
    copies = [(i, f"{base} x{i % 3} y{i % 3}") for i in range(150)]  # three sets, in more tasks than FEW
    near = [(1000 + i, " ".join(f"u{j}" for j in range(80)) + f" z{i}") for i in range(40)]  # more sets than FEW
    alone = [(2000 + i, " ".join(f"v{i}_{j}" for j in range(40))) for i in range(20)]
    df = spark.createDataFrame(copies + near + alone, "doc_id long, text string")
    want = {i: 0 for i, _ in copies} | {i: 1000 for i, _ in near} | {i: i for i, _ in alone}
    for partitions in (1, 50):
        assert {r.doc_id: r.component_id for r in components(df.repartition(partitions)).collect()} == want


@pytest.mark.parametrize("join", [ngram_join.Join(), ngram_join.Join(5, 80)])
def test_passages_that_long_sets_share_tie_none_together(spark, join):
    """What a chain of long texts, or all of them, share by chance makes no candidate component, and near copies still link."""
    own = [" ".join(f"v{i}_{j}" for j in range(2000)) for i in range(40)]
    chain = [" ".join(f"p{i}_{j}" for j in range(25)) for i in range(41)]
    common = " ".join(f"c{j}" for j in range(30))
    texts = [f"{chain[i]} {own[i]} {common} {chain[i + 1]}" for i in range(40)]
    long = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    flat = spark.sparkContext.broadcast(np.zeros(ngram_join.SKETCH, np.int64))  # an order that tells common shingles from none
    assert ngram_join._candidates(long, join, flat).count() == 0
    near = [(100 + i, t.replace("_7 ", f"_7x{i} ").replace("_900 ", "_900x ")) for i, t in enumerate(texts)]
    many = [(200 + i, f"{texts[3]} {texts[3][:200]} z{i} z") for i in range(40)]  # more sets than FEW
    both = long.union(spark.createDataFrame(near + many, "doc_id long, text string"))
    want = {i: i % 100 for i in (*range(40), *range(100, 140))} | {i: 3 for i, _ in many}
    assert {r.doc_id: r.component_id for r in ngram_join.components(both, join).collect()} == want


def test_estimates_do_not_grow_with_star_rounds(spark, monkeypatch):
    """Each round of stars made the digits of the planner's estimate four times as many, until the driver's memory was full of them."""
    monkeypatch.setattr(ngram_join, "BLOCK", 4000)  # both calls of the stars
    words = [f"w{i}" for i in range(200)]
    chain = [(i, " ".join(words[4 * i : 4 * i + 80])) for i in range(8)]  # each links with the next only
    out = ngram_join.components(spark.createDataFrame(chain, "doc_id long, text string"))
    assert {(r.doc_id, r.component_id) for r in out.collect()} == {(i, 0) for i in range(8)}
    assert int(out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < 10**400


def test_estimates_of_the_pipelines_join_stay_small(spark, monkeypatch):
    """No checkpoint of the pipeline's third stage has an estimate whose digits grew with the rounds of the stars."""
    import corpus_pipeline as p

    sizes, cut = [], ngram_join.cut

    def seen(df):
        sizes.append(int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        return cut(df)

    monkeypatch.setattr(ngram_join, "BLOCK", 4000)
    monkeypatch.setattr(ngram_join, "cut", seen)
    words = [f"w{i}" for i in range(200)]
    chain = [(i, " ".join(words[4 * i : 4 * i + 80])) for i in range(8)]
    docs = spark.createDataFrame(chain, "doc_id long, text string")
    assert [r.doc_id for r in p.near_duplicates(spark, docs, SF).collect()] == [0]
    assert len(sizes) > 4 and max(sizes) < 10**400


def test_prefixes_of_linked_sets_share_what_is_asked():
    """For pairs at the threshold, in random orders: enough shingles of few sets, or enough of many, wherever the line is."""
    rng = np.random.default_rng(4)
    for join in (ngram_join.Join(), ngram_join.Join(5, 80)):
        for a in [*range(1, 40), 100, 127, 128, 300, 999, 2600]:
            for b in {a, min(a + 1, a * 100 // join.percent), a * 100 // join.percent}:
                needed = int(join.needed(a, b))
                if needed > a:
                    continue
                order = rng.permutation(a + b - needed)
                x, y = np.sort(order[:a]), np.sort(order[a - needed :])
                px, py = x[: join.prefix(np.array([a]))[0]], y[: join.prefix(np.array([b]))[0]]
                shared = min(int(ngram_join._shared(a)), needed)
                assert len(np.intersect1d(px, py)) >= shared
                many = max(shared // 2, 1)
                low = (join.percent * b + 99) // 100
                least = max(min(int(ngram_join._shared(low)), int(join.needed(low, b))) // 2, 1)
                assert low <= a and least <= many  # both sets reach the star


def test_stages_leave_no_texts_behind(spark):
    """What lies in the shared folder while a stage runs is its own: neither the classifier's texts nor earlier stages."""
    import corpus_pipeline as p
    from partgraph.llm.common import shared_folder

    top = Path(shared_folder(spark).removeprefix("file:"))
    files = lambda: {f.name for f in top.rglob("*.parquet")}
    before = files()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert p.quality(spark, docs, SF).count() and files() == before
    folders = {f for f in top.rglob("stage*.parquet")}
    assert p.run(spark, SF).count()
    assert {f.name for f in set(top.rglob("stage*.parquet")) - folders} == {"stage4.parquet"}
