"""The methods themselves, against brute force, without Spark."""

import hashlib
import itertools
import random

import numpy as np
import pytest

from partgraph.llm import chat, common, licenses, matroska, ngram_join, quality, secrets, suffix_dedup


def block(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw])).astype(np.int64)


def test_words_do_not_cross_texts():
    data, offsets = block(["ab cd", "", "ef", "Gh-é i"])
    starts, ends, first = common.word_spans(data, offsets, common.ALNUM)
    words = [bytes(data[a:b]).decode() for a, b in zip(starts, ends)]
    assert words == ["ab", "cd", "ef", "Gh", "é", "i"]
    assert first.tolist() == [0, 2, 2, 3, 6]
    h = common.word_hashes(*block(["x AB y ab"])[:1], np.array([2, 7]), np.array([4, 9]))
    assert h[0] == h[1]


def test_shingles_of_short_texts():
    data, offsets = block(["a b c d e", "a b", "", "b a", "a b"])
    bounds, hashes = common.distinct_shingles(data, offsets, common.NONSPACE, 4)
    assert np.diff(bounds).tolist() == [2, 1, 0, 1, 1]
    assert hashes[bounds[1]] == hashes[bounds[4]] != hashes[bounds[3]]


def test_suffix_array():
    rng = random.Random(3)
    for _ in range(80):
        n, k = rng.randint(1, 300), rng.choice([2, 3, 5, 250])
        t = np.array([rng.randint(1, k) for _ in range(n)] + [0], np.uint16)
        assert suffix_dedup.suffix_array(t, k + 1).tolist() == sorted(range(n + 1), key=lambda i: t[i:].tolist())


def test_repeated_windows():
    rng = random.Random(4)
    word = lambda n: bytes(rng.choice(b"abcdefgh ") for _ in range(n))
    shared = word(230)
    segments = [word(50) + shared + word(40), shared + word(10), word(300), word(260)]
    seg, a, b = suffix_dedup.repeated_windows(segments, np.array([1, 10**6, 2 * 10**6, 3 * 10**6], np.uint64), np.array([0, 0, 0, 1], bool))
    found = sorted(zip(seg.tolist(), a.tolist(), b.tolist()))
    assert found == [(0, 50, 280), (1, 0, 230), (3, 0, 260)]


def test_prefix_tree_finds_all_components():
    rng, join = random.Random(5), ngram_join.Join(4, 85)
    for _ in range(30):
        sets = []
        for _ in range(rng.randint(1, 8)):
            base = [rng.getrandbits(60) for _ in range(rng.randint(1, 40))]
            for _ in range(rng.randint(1, 5)):
                x = set(base)
                for _ in range(rng.randint(0, 5)):
                    x.add(rng.choice([rng.getrandbits(60), 7, 8])) if rng.random() < 0.5 or len(x) < 2 else x.pop()
                sets.append(np.array(sorted(x), np.uint64))
        parent = list(range(len(sets)))

        def root(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for i, j in itertools.combinations(range(len(sets)), 2):
            a, b = set(sets[i].tolist()), set(sets[j].tolist())
            if 100 * len(a & b) >= 85 * len(a | b):
                parent[root(i)] = root(j)
        got, want = ngram_join.link_sets(sets, join).tolist(), [root(i) for i in range(len(sets))]
        assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


@pytest.mark.parametrize("lacing", range(4))
def test_matroska_round_trip(lacing):
    for n in (1, 7, 8, 9, 300):
        payload = random.Random(n).randbytes(n * matroska.FRAME)
        data = matroska.mux(payload, lacing=lacing)
        m = matroska.parse(data)
        assert m.error is None and b"".join(data[s : s + z] for _, _, s, z, _, _ in m.packets) == payload
        assert [c[2] for c in m.cues] == m.clusters
        assert [p[1] for p in m.packets] == [i * 72_000_000 for i in range(n)]


def test_matroska_uneven_laces_unknown_sizes_and_damage():
    sizes = [3, 700, 2, 9]
    body = bytes(range(256)) * 3
    for kind in (matroska.XIPH, matroska.EBML_LACING):
        frames = [body[:n] for n in sizes]
        lace = matroska._lace_head(sizes, kind)
        found = matroska.laced(lace + b"".join(frames), 0, len(lace) + sum(sizes), kind)
        assert [z for _, z in found] == sizes
    block_ = matroska.element(matroska.SIMPLE_BLOCK, b"\x81\x00\x05\x80" + b"abc")
    cluster = b"\x1f\x43\xb6\x75\xff" + matroska.element(matroska.TIMESTAMP, b"\x02") + block_
    data = matroska.element(matroska.EBML, matroska.element(matroska.DOC_TYPE, b"webm"))
    data += b"\x18\x53\x80\x67\x01\xff\xff\xff\xff\xff\xff\xff" + cluster + cluster
    m = matroska.parse(data)
    assert m.doc_type == "webm" and [(p[0], p[1], data[p[2] : p[2] + p[3]]) for p in m.packets] == [(1, 7_000_000, b"abc")] * 2
    cut = matroska.parse(data[:-2])
    assert cut.error and len(cut.packets) == 1
    assert matroska.parse(b"").error == "no EBML header"


def test_automaton_statistics():
    a = licenses.Automaton()
    sequences = [[1, 2, 3, 1, 2], [2, 3, 4]]
    for i, s in enumerate(sequences):
        a.add(i, s)
    a.close()
    rng = random.Random(1)
    factors = {tuple(s[i:j]): 0 for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    text = [rng.randint(1, 5) for _ in range(300)]
    for i, (state, length) in enumerate(a.stream(text)):
        want = max((n for n in range(6) if n <= i + 1 and (n == 0 or tuple(text[i + 1 - n : i + 1]) in factors)), default=0)
        assert length == want
        for number, end in a.ends[state]:
            assert sequences[number][end - length : end] == text[i + 1 - length : i + 1]


def test_license_spans():
    s = licenses.Scanner(licenses.BASE, licenses.TEMPLATES)
    words = sorted({w for x in (*licenses.BASE, *licenses.TEMPLATES.values()) for w in licenses.words_of(x)})
    ids = {w: i + 1 for i, w in enumerate(words)}
    text = "see Licensed under the Apache License, Version 2.0 and the MIT License"
    runs = [(0, [ids.get(w, 0) for w in licenses.words_of(text)])]
    base, spans = s.scan(runs)
    assert {s.labels[k]: v for k, v in base.items()} == {"apache": [4], "mit": [11]}
    assert ("apache-2.0-notice", 1, 9, 1.0) in spans


def test_chat_costs_are_least():
    def brute(roles):
        cost = {0: 0}
        for r in roles:
            new = {}
            for s, c in cost.items():
                for t in (1, 2, 3):
                    relabel = 2 * (r != t)
                    if s == t:
                        new[t] = min(new.get(t, 99), c + 1 + relabel)
                    reached, k = {s}, 0
                    while k < 4:
                        if any(t in chat.NEXT[x] for x in reached):
                            new[t] = min(new.get(t, 99), c + 3 * k + relabel)
                            break
                        reached, k = {y for x in reached for y in chat.NEXT[x]}, k + 1
            cost = new
        return min(c + {0: 0, 1: 6, 2: 3, 3: 0}[s] for s, c in cost.items())

    for n in range(5):
        for roles in itertools.product(range(4), repeat=n):
            entry, leave = chat.plan([chat.through(list(roles))])[0]
            text, done = chat.render(list(roles), ["t"] * n, entry, leave, True)
            out = [r for r, _ in chat.to_messages(text)]
            assert done["cost"] == brute(roles) and len(out) == done["turns_out"]
            rest = out[1:] if out[:1] == ["system"] else out
            assert all(r == ("user", "assistant")[i % 2] for i, r in enumerate(rest)) and out[-1:] in ([], ["assistant"])


def test_secrets():
    with open(secrets.VOCABULARY, "rb") as f:
        tokens = secrets.Tokens(f.read())

    def found(text):
        base = secrets.base_spans(text)
        return secrets.joined(base + secrets.random_spans(text, base, tokens))

    assert found('x API-key = 1 api_key: "abcdef" é') == "assign:14:30"
    assert found("PASSWORD=12345") == ""
    assert found("AKIA" + "B2" * 8) == "access:0:20" and found("AKIA" + "B" * 15) == ""
    assert found("0" * 24) == "hex:0:24"
    assert found("go q8Zr7LpX2vNw9TbK4mYd now") == "token:3:23"
    assert found("go 123e4567-E89b-12d3-a456-426614174000 now") == ""  # an identifier
    assert found("sha256: q8Zr7LpX2vNw9TbK4mYd") == ""  # a digest
    assert found("internationalization_of_documents_v2") == ""


def test_isotonic():
    means = quality.isotonic(np.array([1.0, 0, 2, 1, 3]), np.array([1.0, 1, 2, 2, 3]))
    assert np.all(np.diff(means) >= 0) and means[-1] == 1.0 and means[0] == means[1] == 0.5


def test_text_stats_are_whole():
    data, offsets = block(["", "aa aa aa\nB! 1", "é"])
    x = quality.text_stats(data, offsets)
    assert x.shape == (3, len(quality.STATS)) and np.isfinite(x).all() and not x[0, 1:].any()
    assert x[1, quality.STATS.index("repeats")] == 2 / 5


def test_rolling_hashes():
    t = np.frombuffer(b"abcabcabc", np.uint8)
    h = suffix_dedup.Rolling(t).every(3)
    assert h[0] == h[3] == h[6] != h[1]
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_long_texts_in_pieces(monkeypatch):
    """A text of several blocks gives what one block of it would."""
    rng = random.Random(9)
    text = " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(60_000)) + "\n" + "y" * 5000
    data, offsets = block([text * 6])
    assert len(data) > 2 * common.BLOCK_BYTES
    here = quality.text_stats(data, offsets), *common.distinct_shingles(data, offsets, common.NONSPACE, 4)
    with monkeypatch.context() as m:
        for module in (common, quality):
            m.setattr(module, "BLOCK_BYTES", 1 << 30)
        whole = quality.text_stats(data, offsets), *common.distinct_shingles(data, offsets, common.NONSPACE, 4)
    assert np.allclose(here[0], whole[0]) and all(np.array_equal(a, b) for a, b in zip(here[1:], whole[1:]))


def test_windows_in_pieces(monkeypatch):
    data, offsets = block(["".join(random.Random(2).choice("ab ") for _ in range(3000))])
    gram, _, start, windows, _ = suffix_dedup.window_runs(data, offsets)
    of = {p: g for g, s, n in zip(gram, start, windows) for p in range(s, s + n)}
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    got = {p: g for gram, _, start, windows, _ in suffix_dedup.text_windows(data, offsets) for g, s, n in zip(gram, start, windows) for p in range(s, s + n)}
    assert got == of and len(got) == 3000 - 199


def test_suffix_array_of_large_alphabets_and_runs():
    rng = random.Random(1)
    t = np.array([rng.randint(1, 4000) for _ in range(3000)] * 2 + [0])
    assert suffix_dedup.suffix_array(t, 4001).tolist() == sorted(range(6001), key=lambda i: t[i:].tolist())
    run = np.array([5] * 3000 + [0], np.uint16)
    assert suffix_dedup.suffix_array(run, 258).tolist() == list(range(3000, -1, -1))


def scan_words(scanner, text):
    data, offsets = block([text])
    hashes, _, _, first = common.hashed_words(data, offsets, common.ALNUM)
    tokens = scanner.tokens(hashes)
    return scanner.scan([(x, tokens[x:y].tolist()) for _, x, y in scanner.runs(tokens, first)])


def test_license_chains_and_recall():
    t = [f"w{i}" for i in range(50)]
    s = licenses.Scanner({"one": "one"}, {"t": " ".join(t), "two": "aa bb"})
    # A chance match of a later part before the whole, a lost word, a one-word phrase, a two-word template.
    assert scan_words(s, "w30 w31 w32 x " + " ".join(t))[1] == [("t", 4, 54, 1.0)]
    assert scan_words(s, " ".join(t[:20] + ["q"] + t[22:]))[1] == [("t", 0, 49, 0.96)]
    assert scan_words(s, "zz aa bb one") == ({0: [3]}, [("two", 1, 3, 1.0)])
    s, rng, found = licenses.Scanner(licenses.BASE, licenses.TEMPLATES), random.Random(4), 0
    for label, template in licenses.TEMPLATES.items():
        words = licenses.words_of(template)
        if len(words) >= 10:
            words[rng.randrange(len(words))] = "changed"
        found += any(x[0] == label for x in scan_words(s, "before it " + " ".join(words) + " after")[1])
    assert found >= 0.9 * len(licenses.TEMPLATES)


def test_secret_recall():
    with open(secrets.VOCABULARY, "rb") as f:
        tokens = secrets.Tokens(f.read())
    rng, found = random.Random(5), 0
    for n in range(300):
        key = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(20 + n % 20))
        text = f"the key {key} is here"
        found += secrets.random_spans(text, secrets.base_spans(text), tokens) == [(8, 3, 8 + len(key))]
    assert found >= 0.9 * 300
