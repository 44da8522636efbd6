"""Each operator against a brute-force version, on rows with nulls, empty, very long and repeated texts, and extra columns."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import chat, decontam, forest, kdshards, packing, rans, resample, simhash, tokencount, warc
from quarry.llm.components import connected_components
from quarry.llm.queries import tokenizer

RNG = random.Random(7)
VOCABULARY = ["".join(RNG.choice("abcdeéßñ") for _ in range(RNG.randint(1, 9))) for _ in range(400)]
EXTRA = ["start", "length", "fp", "text_key", "shard", "class", "h", "words", "a", "b", "size_", "item_id"]


def prose(n):
    return " ".join(RNG.choice(VOCABULARY) + RNG.choice(["", "", "", ",", ".\n", "!!"]) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    base = [prose(RNG.randint(1, 200)) for _ in range(60)]
    texts = base + base[:5] + [None, "", "", " \n\t", "a", "X" * 5000, prose(20_000), "it's <|endoftext|> 'll  two   spaces   end ", "あい 12½", base[0] + " z"]
    rows = [(i, t, "en" if i % 3 else None, f"src{i % 2}", 0 if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[3], (None, "no id", "en", "src0", 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return df.withColumns({c: F.lit(-1) for c in EXTRA}).repartition(3)


def pairs(df):
    return [(r.doc_id, (r.text or "")) for r in df.collect()]


def tok(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer(name))


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_ids_in_files(docs):
    t = tok("word_bpe_49k.json")
    got = rans.round_trip(docs, tokenizer("word_bpe_49k.json")).collect()
    want = collections.Counter((d, len(ids), crc(ids)) for d, x in pairs(docs) for ids in [t.encode(x, add_special_tokens=False).ids + [2]])
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    rows, at = sorted(got, key=lambda r: r.start), 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in rows]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    assert rans.round_trip(docs.limit(0), tokenizer("word_bpe_49k.json")).count() == 0


def test_token_ids_in_several_files_of_a_range(spark, docs, tmp_path):
    name, columns = tokenizer("word_bpe_49k.json"), ["doc_id", "start", "n_tokens", "ids_crc32"]
    manifest = rans.write_ids(docs, f"file://{tmp_path}/ids", name, file_ids=500)
    files = manifest.collect()
    assert max(r.part for r in files) > 2 and len({r.file for r in files}) == len(files)
    one = rans.round_trip(docs, name).select(columns).collect()
    assert collections.Counter(rans.read_ids(manifest).select(columns).collect()) == collections.Counter(one)


def test_rans_blocks_and_checksums():
    rng = np.random.default_rng(1)
    for ids in (np.array([5]), np.full(100_000, 7), rng.integers(0, 49_000, 70_001), rng.zipf(1.3, 200_000) % 49_408):
        f, k = rans.frequencies(np.bincount(ids))
        assert f.sum() == 1 << k
        blocks = rans.encode_blocks(ids.astype(np.uint32), f, k)
        assert (rans.decode_blocks(blocks, f, k) == ids).all()
        with pytest.raises(ValueError):
            rans.decode_blocks([blocks[0][:-1] + bytes([blocks[0][-1] ^ 1]), *blocks[1:]], f, k)


def test_packing(docs):
    t, by = tok("byte_bpe_50k.json"), collections.defaultdict(list)
    want = collections.Counter()
    for d, x in pairs(docs):
        want[(d, crc(ids := t.encode(x, add_special_tokens=False).ids + [0]), len(ids))] += 1
    got = packing.pack(docs, tokenizer("byte_bpe_50k.json"), with_ids=True)
    rows = got.collect()
    texts = collections.defaultdict(list)
    for r in rows:
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
        by[r.sequence_id].append((r.offset, r.length))
        texts[r.doc_id].append(r)
    for spans in by.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 1024
    for (d, c, n), many in want.items():
        own = sorted((r.start, r.ids) for r in texts[d] if r.doc_tokens == n)
        assert sum(len(x) for _, x in own) >= 4 * n
        if len([1 for w in want if w[0] == d]) == 1:
            assert b"".join(dict(own).values()) and zlib.crc32(b"".join(v for _, v in sorted(dict(own).items()))) == c
            assert len(own) == many * len(dict(own))
    total = sum(r.length for r in rows)
    assert sum(1024 - sum(n for _, n in s) for s in by.values() if bin(sum(n for _, n in s)).count("1") > 1) < 0.05 * total + 1024
    for r in packing.sequences(got).collect():
        n = r.n_tokens
        assert len(r.ids) == 4 * (n if n & (n - 1) == 0 else 1024)
    assert packing.pack(docs.limit(0), tokenizer("byte_bpe_50k.json")).count() == 0
    for n in range(1, 3000, 7):
        assert sum(packing.cut_lengths(n)) == n


def test_token_counts(docs):
    t = tok("byte_bpe_50k.json")
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tokencount.token_counts(docs, tokenizer("byte_bpe_50k.json")).collect())
    assert got == collections.Counter((d, len(x.encode()), n, n > 512) for d, x in pairs(docs) for n in [len(t.encode(x, add_special_tokens=False).ids)])


def test_transducers_on_odd_strings():
    t, c = tok("byte_bpe_50k.json"), tokencount.TokenCounter(tokenizer("byte_bpe_50k.json"))
    parts = ["'", "s", "t", "re", "ve", "ll", "m", "d", " ", "  ", "\n", "\t", "a", "B", "é", "1", "23", "!", "***", "<|endoftext|>", " ", "　", "中", "\U0001f600", "r", "v", "l", "e", "\0", "\r\n", "٣", "the", " un"]
    texts = ["".join(RNG.choice(parts) for _ in range(RNG.randint(0, 30))) for _ in range(3000)] + ["x" * 5000, "\n" * 3000, " " * 3000, ""]
    assert c.count([x.encode() for x in texts]).tolist() == [len(e.ids) for e in t.encode_batch_fast(texts, add_special_tokens=False)]


def test_long_words_and_few_states(monkeypatch):
    t, rng = tok("byte_bpe_50k.json"), random.Random(6)
    words = ["".join(rng.choice("abcXYZ") for _ in range(30_000)), "x" * 20_000, "ab" * 9000, "é" * 5000, "".join(rng.choice(["the", "ing", "tion"]) for _ in range(5000)), "a" * 1024, "b" * 1025, "-" * 3000 + "a" * 2048]
    want = [len(t.encode(w, add_special_tokens=False).ids) for w in words]
    c = tokencount.TokenCounter(tokenizer("byte_bpe_50k.json"))
    assert c.count([w.encode() for w in words]).tolist() == want
    monkeypatch.setattr(tokencount, "STATES", 300)
    assert c.count([w.encode() for w in words]).tolist() == want and len(c.counter.states) < 3000
    ids = list(c.counter.bytes)
    for _ in range(3000):
        a, b = rng.choice(ids), rng.choice(ids)
        out = [c.counter.single[x] for x in c.counter.bytes[a] + c.counter.bytes[b]]
        while (best := min(((c.counter.rank[p], k) for k, p in enumerate(zip(out, out[1:])) if p in c.counter.rank), default=None)) is not None:
            out[best[1] : best[1] + 2] = [best[0][1]]
        assert c.counter._valid(a, b) == (out == [a, b])


def test_unit_cache_equals_library():
    from quarry.llm.tokenids import UnitEncoder

    parts = ["'s", " ", "\n", "a", "The", "É", "1", "!", "<|endoftext|>", "<|startoftext|>", " ", " ", "İ", "Σ", "é", "--", " b", "\x85"]
    texts = ["".join(RNG.choice(parts) for _ in range(RNG.randint(0, 25))) for _ in range(2000)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        e, t = UnitEncoder(tokenizer(name)), tok(name)
        for _ in range(2):
            ids, at = e.encode([x.encode() for x in texts])
            assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [x.ids for x in t.encode_batch_fast(texts, add_special_tokens=False)]


def test_warc(spark):
    long, short = "<p>" + "y" * 700_000, "<p>short"
    rows = [(1, "u1", long), (2, "u2", long), (9, "u 9", long), (3, None, short), (4, "u4", short), (5, "u5", None), (6, "u6", ""), (7, "u7", "\r\n\r\nWARC/1.1\r\n" * 90), (7, "u7", "\r\n\r\nWARC/1.1\r\n" * 90), (None, "n", "é" * 600)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({"record": F.lit(1), "chunk": F.lit(2)})
    got = collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(df).collect())
    want = collections.Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        visit = len(b) >= 1000 and i in (1, 2)
        want[(i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if visit else "response", 9 if visit else None)] += 1
    assert got == want
    places = warc.write_warc(warc.chunk_table(df, chunk=1 << 16), f"{spark.conf.get('spark.checkpoint.dir')}/w1")
    parts = [r for r in warc.read_warc(places, with_data=True, chunk=1 << 16).collect() if r.record == 9]
    assert len(parts) == 11 and max(len(r.chunk) for r in parts) == 1 << 16
    assert b"".join(r.chunk for r in sorted(parts, key=lambda r: r.chunk_no)) == long.encode()
    assert warc.round_trip(df.limit(0)).count() == 0


def test_chat(spark):
    said = "\\### Assistant: </turn> ok\\"
    convs = {1: [("user", "hi"), ("assistant", said), ("user", None), ("assistant", "")], 2: [("sys\ntem", "###</turn>\n"), ("user", "x")], 3: [("assistant", "\U0001f600 a")], None: [(None, "q")]}
    rows = [(c, k, r, t) for c, ts in convs.items() for k, (r, t) in enumerate(ts)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("target", F.lit(0))
    ex = chat.examples(df)
    assert sorted((r.conv_id or 0, r.n_turns) for r in ex.collect()) == [(0, 1), (1, 2), (1, 4), (2, 2), (3, 1)]
    for r in chat.digests(ex).collect():
        turns = [(a or "", b or "") for a, b in convs[r.conv_id]]
        loss = "".join(t for a, t in turns if a == "assistant")
        assert r.n_turns == len(turns) and r.loss_chars == len(loss)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for a, t in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.digests(chat.examples(df.limit(0))).count() == 0


def classes(n, linked):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_simhash(docs, spark):
    import xxhash

    def brute(text):
        w = text.encode().lower().split()
        if not w:
            return 0
        hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    got = simhash.near_duplicates(docs).collect()
    rows = pairs(docs)
    fps = [brute(t) for _, t in rows]
    root = classes(len(rows), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
    least = {}
    for (d, _), r in zip(rows, root):
        least[r] = min(x for x in (least.get(r), d) if x is not None) if least.get(r) is not None or d is not None else None
    want = collections.Counter((d, f, least[r]) for (d, _), f, r in zip(rows, fps, root))
    assert collections.Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in got) == want
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    rng = np.random.default_rng(2)
    many = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    many = np.unique(np.concatenate([many, many[:300] ^ np.uint64(5), many[:200] ^ np.uint64((1 << 60) + 7)]))
    links = simhash.links(spark.createDataFrame([(int(x),) for x in many.view(np.int64)], "fp bigint"))
    named = {r.node: r.component for r in connected_components(links).collect()}
    near = np.bitwise_count(many[:, None] ^ many[None, :]) <= 3
    u, v = np.nonzero(near)
    root = simhash.roots(len(many), u, v)
    groups = collections.defaultdict(set)
    for x, r in zip(many.view(np.int64).tolist(), root):
        groups[r].add(x)
    for g in groups.values():
        assert len(g) == 1 or {named[x] for x in g} == {min(g)}


def test_components_on_a_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(51)} | {100 + i: 100 for i in range(60)}


@pytest.mark.parametrize("path", [(2, 3, 4, 5, 1), (1, 5, 4, 3, 2), (3, 7, 5, 6, 2, 8, 4, 1)])
def test_components_on_short_permuted_paths(spark, path):
    got = connected_components(spark.createDataFrame(list(zip(path, path[1:])), "a bigint, b bigint")).collect()
    assert sorted((r.node, r.component) for r in got) == [(x, 1) for x in sorted(path)]


def test_containment(docs, spark):
    texts = dict(x for x in pairs(docs) if x[0] is not None)
    words = decontam_words
    some = words(max(texts.values(), key=len))
    items = [(1, " ".join(some[900:930])), (2, " ".join(some[3000:3020] + ["zzz"] * 3)), (3, "a"), (4, None), (5, "...!"), (6, " ".join(some[40:60:2])), (7, texts[0]), (7, texts[0]), (None, " ".join(some[5:12]))]
    df = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(1))
    got = {(r.doc_id, r.item_id): (r.n_shingles, r.n_found) for r in decontam.contaminated(docs, df).collect()}
    grams = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    want = {}
    for i, t in dict(items).items():
        w = words(t or "")
        for d, x in pairs(docs):
            if len(w) >= 5:
                own = grams(w, 5)
                found = len(own & grams(words(x), 5))
                if found >= 0.8 * len(own):
                    want[d, i] = len(own), found
    assert got == want and (None, 1) not in got and len(want) > 5
    assert decontam.contaminated(docs, df.limit(0)).count() == 0 == decontam.contaminated(docs.limit(0), df).count()


def test_forest(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((300, 16))
    rows = [(i, [float(x) for x in centres[i % 300] + rng.standard_normal(16) * 0.18], i % 2) for i in range(1200)]
    rows += [(2000, rows[0][1], 0), (2001, rows[0][1], 1), (2002, None, 0), (2003, [0.0] * 16, 0), (2004, [float("nan")] + [1.0] * 15, 0), (2005, rows[2][1], None), (2006, [1.0, 2.0], 0), (2007, [None] * 16, 0), (2008, [], 0), (2000, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").withColumn("uid", F.lit(1))
    got = forest.similar(df, leaf=32).collect()
    usable = [(i, v, lb) for i, v, lb in rows if lb is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    x = {len(v): None for _, v, _ in usable}
    links, near = collections.Counter(), []
    for a in range(len(usable)):
        for b in range(a):
            (i, v, p), (j, w, q) = usable[a], usable[b]
            if p == q and len(v) == len(w) and np.dot(v, w) / (np.linalg.norm(v) * np.linalg.norm(w)) >= 0.93:
                links[a] += 1
                links[b] += 1
                near.append((a, b))
    want = sum(links.values())
    assert sum(r.n_links for r in got) >= 0.99 * want > 500 and sum(r.n_links for r in got) <= want
    root = classes(len(usable), lambda a, b: (a, b) in linked) if (linked := set(near)) else []
    least = {}
    for (i, _, _), r in zip(usable, root):
        least[r] = min(least.get(r, i), i)
    names = {i: least[r] for (i, _, _), r in zip(usable, root)}
    assert sum(names.get(r.vec_id, r.vec_id) == r.component_id for r in got) >= 0.99 * len(got)
    assert all(r.n_links == 0 and r.kept for r in got if r.vec_id in range(2002, 2009))
    assert {r.component_id for r in got if r.vec_id == 2000} == {r.component_id for r in got if r.vec_id == 0}
    assert forest.similar(df.limit(0)).count() == 0 and x


def test_forest_on_scaled_copies_and_null_ids(spark):
    rng = np.random.default_rng(9)
    base, other = rng.standard_normal(8), rng.standard_normal((300, 8))
    rows = [(i, [float(x) for x in base * (1 + i)], 1) for i in range(200)] + [(1000 + i, [float(x) for x in v], 1) for i, v in enumerate(other)] + [(None, [float(x) for x in base], 1), (None, [float(x) for x in other[0]], None)]
    got = forest.similar(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"), leaf=32).collect()
    ids = [r for r in got if r.vec_id is not None and r.vec_id < 200]
    assert len(got) == len(rows) and {r.component_id for r in ids} == {0} and all(r.n_links >= 200 for r in ids) and sum(r.kept for r in ids) == 1
    assert sorted((r.n_links > 0, r.component_id, r.kept) for r in got if r.vec_id is None) == [(False, None, False), (True, 0, False)]


def test_kd_shards(docs):
    got = kdshards.shards(docs, 7).collect()
    want = collections.Counter((d, len(t.encode()) + 16, zlib.crc32(t.encode())) for d, t in pairs(docs))
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    for rows in by.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
    assert set(by) <= set(range(7))
    plain = docs.filter("length(text) < 2000")
    sizes = collections.Counter()
    for r in kdshards.shards(plain, 4).collect():
        sizes[r.shard] += r.size
    assert max(sizes.values()) - min(sizes.values()) <= 3 * 1600
    assert kdshards.shards(docs.limit(0), 7).count() == 0


def test_kd_shards_by_whole_strings_and_hot_values(spark):
    rows = [(i, f"text {i}" if i % 3 else "hot", "en", None if i % 50 == 7 else f"https://site{i % 50:03d}.example") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").repartition(3)
    ranks = [(r.value, r["rank"]) for r in kdshards._ranks(df, F.col("source")).collect()]
    assert sorted(ranks) == [(s, float(k + 1)) for k, s in enumerate(sorted({s for *_, s in rows if s}))]
    of, sizes, sources = {}, collections.Counter(), dict((i, s) for i, _, _, s in rows)
    for r in kdshards.shards(df, 6, dimensions=("source",)).collect():
        of[r.doc_id] = r.shard
        sizes[r.shard] += r.size
    assert max(sizes.values()) - min(sizes.values()) < 0.05 * sum(sizes.values())
    order = [of[i] for i in sorted(of, key=lambda i: (sources[i] is not None, sources[i] or ""))]
    spans = [(sources[min((i for i in of if of[i] == s), key=lambda i: sources[i] or "")] or "", sources[max((i for i in of if of[i] == s), key=lambda i: sources[i] or "")]) for s in sorted(set(order))]
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_resampling_by_brute_force(spark):
    from quarry.llm.ngrams import _MIX, BUCKETS

    def hashed(gram):
        h = len(gram)
        for k, b in enumerate(gram):
            h = ((h ^ b) * int(_MIX[k])) % 2**64
            h ^= h >> 29
        return h % BUCKETS

    def grams(text):
        data, seen = text.encode(), set()
        out = [hashed(data[i : i + n]) for n in (2, 4) for i in range(len(data) - n + 1)]
        words = [w for w in regex_words(data)]
        for pair in zip(words, words[1:]):
            out.append(BUCKETS + (pair in seen))
            seen.add(pair)
        return out

    rng = random.Random(4)
    rows = [(i, prose(rng.randint(1, 60))) for i in range(120)] + [(200 + i, f"{rng.choice(VOCABULARY)} " * rng.randint(5, 60)) for i in range(40)] + [(300, None), (301, ""), (0, "again"), (None, prose(9))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    labels = {i: 1 for i in range(0, 120, 2)} | {200 + i: 0 for i in range(0, 40, 2)}
    got = resample.select(df, spark.createDataFrame(list(labels.items()), "doc_id bigint, quality int")).collect()
    held = {i for i, q in labels.items() if q and zlib.crc32(str(i).encode()) % 5 == 0}
    raw, target = collections.Counter(), collections.Counter()
    for i, t in rows:
        raw.update(grams(t or ""))
        if labels.get(i) == 1 and i not in held:
            target.update(grams(t or ""))
    m = BUCKETS + 2
    ratio = lambda b: np.log((target[b] + 1) / (sum(target.values()) + m)) - np.log((raw[b] + 1) / (sum(raw.values()) + m))
    want = [(i, np.mean([ratio(b) for b in grams(t or "")] or [0.0])) for i, t in rows]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    for (i, w), (j, v) in zip(sorted(want, key=key), sorted(((r.doc_id, r.log_weight) for r in got), key=key)):
        assert i == j and v == pytest.approx(w, abs=1e-9)
    lowest = lambda ids: [min(w for i, w in want if i == d) for d in ids]
    cut = resample.cut_between(np.array(lowest(held)), np.array(lowest({i for i, q in labels.items() if not q})))
    k = sum(w >= cut for _, w in want)
    kth = sorted((r.gumbel_key for r in got), reverse=True)[k - 1]
    assert 0 < k < len(rows) and all(r.selected == (r.gumbel_key >= kth) for r in got)
    assert all(abs(r.gumbel_key - r.log_weight / resample.TEMPERATURE) < 40 for r in got)
    assert resample.cut_between(np.array([1.0, 2, 3, 4]), np.array([0.0, 0.5]), 0.95) == 0.75
    assert resample.cut_between(np.array([1.0, 2]), np.array([])) == 1.0 and resample.cut_between(np.array([1.0, 3]), np.array([2.0, 5]), 0.95) == 1.0


def regex_words(data):
    """Words, each with the white space behind it."""
    import re

    return re.findall(rb"[^\x20\x09-\x0d]+[\x20\x09-\x0d]*", data)


def test_resampling(spark, docs):
    good = [(i, prose(80)) for i in range(300)]
    bad = [(1000 + i, " ".join([RNG.choice(VOCABULARY).upper() + "$$$"] * 60)) for i in range(60)]
    rest = [(2000, None), (2001, ""), (2000, None)]
    df = spark.createDataFrame(good + bad + rest, "doc_id bigint, text string").withColumn("log_weight", F.lit(0))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 300, 2)] + [(1000 + i, 0, 0) for i in range(0, 60, 2)] + [(None, 1, 0), (5, None, 0)], "doc_id bigint, quality int, toxic int")
    got = resample.select(df, labels).collect()
    assert len(got) == len(good + bad + rest)
    kept = {r.doc_id for r in got if r.selected}
    assert len(kept & set(range(300))) >= 295 and len(kept & set(range(1000, 1060))) <= 2
    assert {(r.doc_id, r.gumbel_key) for r in got} == {(r.doc_id, r.gumbel_key) for r in resample.select(df.repartition(5), labels).collect()}
    assert all(r.selected for r in resample.select(df, labels.limit(0)).collect())
    assert resample.select(df.limit(0), labels).count() == 0
    values = [RNG.gauss(0, 1) for _ in range(500)] + [0.5] * 20
    v = spark.createDataFrame([(x,) for x in values], "x double")
    for k in (1, 7, 250, 300, 520):
        assert resample.kth_largest(v, "x", k) == (sorted(values, reverse=True)[k - 1] if k < 520 else float("-inf"))


def test_pipeline_stages(spark, tmp_path, docs):
    import corpus_pipeline

    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 3)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    item = " ".join(decontam_words(dict(pairs(plain))[7])[:40])
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    plain.write.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "packing"]
    kept = corpus_pipeline.near_duplicates(spark, plain, str(tmp_path))
    assert kept.columns == plain.columns
    rows = sorted({(d, t) for d, t in pairs(plain)}, key=lambda r: (r[0] is None, r[0] or 0))
    sets = [word_runs(t) for _, t in rows]
    root = classes(len(rows), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9)
    want = [d for i, (d, _) in enumerate(rows) if root.index(root[i]) == i]
    assert collections.Counter(r.doc_id for r in kept.collect()) == collections.Counter(want)
    left = {r.doc_id for r in corpus_pipeline.decontamination(spark, plain, str(tmp_path)).collect()}
    assert left == {d for d, _ in pairs(plain)} - {r.doc_id for r in decontam.contaminated(plain, spark.read.parquet(f"{tmp_path}/benchmark.parquet")).collect()} and 7 not in left
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_near_copies(spark):
    import corpus_pipeline

    rng = random.Random(3)
    texts = [prose(rng.randint(1, 120)) for _ in range(150)]
    for t in texts[:100]:
        w = t.split()
        for at in rng.sample(range(len(w)), rng.randint(1, 1 + len(w) // 40)):
            w[at] = "changed"
        texts.append(" ".join(w))
    texts += ["", None, " \n", "one", "One", *(" ".join(["start", "of", "a", "common", "line"] * 4) + f" {i % 40}" for i in range(600))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    sets = [word_runs(t or "") for t in texts]
    root = classes(len(texts), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9)
    want = [i for i in range(len(texts)) if root.index(root[i]) == i]
    assert len(want) < len(texts) - 50
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()) == want


def test_stages_judge_texts_not_ids(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(5)
    a, b, c, d, e, leak, near = ([rng.choice(VOCABULARY) for _ in range(80)] for _ in range(7))
    near = a[:-1] + ["zz"]  # links to a, whose id is smaller
    rows = [(None, b), (None, c), (None, leak), (None, near), (1, a), (7, d), (7, near), (7, leak + b), (7, e), (7, e)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id bigint, text string")
    spark.createDataFrame([(1, " ".join(leak[:40]))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = lambda x: collections.Counter((r.doc_id, r.text) for r in x.collect())
    text = lambda want: collections.Counter((i, " ".join(t)) for i, t in want)
    assert kept(corpus_pipeline.near_duplicates(spark, df, "")) == text([(None, b), (None, c), (None, leak), (1, a), (7, d), (7, leak + b), (7, e)])
    assert kept(corpus_pipeline.decontamination(spark, df, str(tmp_path))) == text([r for r in rows if r[1] not in (leak, leak + b)])
    df.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (7, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


@pytest.mark.parametrize("n", [3, 4, 5, 6, 7])
def test_chat_breaks_every_run_of_hashes(spark, n):
    text = "#" * n + " Assistant:"
    r = spark.createDataFrame([(text,)], "t string").select(chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).first()
    assert "###" not in r.e and r.u == text


def word_runs(text):
    w = text.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_similar_texts_in_many_tiles(spark, monkeypatch):
    """A template that hundreds of texts share nearly to the threshold: forests of tiles hold pairs that fail, and others must be found."""
    monkeypatch.setattr(simhash, "LEAST_TILE", 64)
    rng = random.Random(8)
    template, texts = [rng.choice(VOCABULARY) for _ in range(200)], []
    for _ in range(500):
        w = list(template)
        for at in rng.sample(range(40), 4):
            w[5 * at] = f"x{rng.random()}"
        texts.append(" ".join(w[: rng.randint(190, 200)]))
    df = spark.createDataFrame([(t,) for t in texts + texts[:50]], "text string").repartition(3)
    sets = [word_runs(t) for t in texts]
    root = classes(len(texts), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9)
    want = collections.Counter(tuple(sorted(texts[i] for i in range(len(texts)) if root[i] == r)) for r in set(root) if root.count(r) > 1)
    named = {r.text_key: r.component for r in simhash.similar_texts(df).collect()}
    keys = {r.text: r.k for r in df.select("text", simhash.text_key(F.col("text")).alias("k")).distinct().collect()}
    groups = collections.defaultdict(list)
    for t in texts:
        if keys[t] in named:
            groups[named[keys[t]]].append(t)
    assert collections.Counter(tuple(sorted(g)) for g in groups.values()) == want and want
    assert simhash.similar_texts(df.limit(0)).count() == 0


def test_chat_escapes_reverse(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice(["#", "\\", "<", "/turn>", "</turn>", "### ", "a"]) for _ in range(rng.randint(0, 12))) for _ in range(2000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect():
        assert r.u == r.t and "###" not in r.e and "</turn>" not in r.e


def decontam_words(text):
    import regex

    return regex.findall(r"[\p{L}\p{N}]+", text.lower())
