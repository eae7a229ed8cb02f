"""Operators against slow, plain versions of the same definition."""

import collections
import json
import random
import re
import zipfile
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tillscope.llm import archives, arrays, decontamination, language, links, ngramjoin, packing, quality, sharding, vectors

WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")


@pytest.fixture(scope="module")
def texts(spark, folder):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}


def roots(count, pairs):
    parent = list(range(count))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(count)]


def test_token_and_shingle_hashes_tell_words_apart():
    column = arrays.text_array(pa.array(["ab cd ab", "", None, "cd ab cd", "ab", "x y z u v w", "y z u v w"]))
    found = arrays.tokens(*arrays.slice_bytes(column, 0, 7))
    ab, cd = found.hashes[:2]
    assert found.bounds.tolist() == [0, 3, 3, 3, 6, 7, 13, 18] and found.hashes[:7].tolist() == [ab, cd, ab, cd, ab, cd, ab]
    hashes, bounds = arrays.shingles(found)
    assert np.diff(bounds).tolist() == [1, 0, 0, 1, 1, 2, 1] and hashes[bounds[5] + 1] == hashes[bounds[6]] and len(set(hashes.tolist())) == 5


def test_quality_scores(spark, texts):
    random = np.random.default_rng(3)
    weights = random.standard_normal((1 << quality.BITS) + 1).astype(np.float32)
    rows = [*list(texts.values())[:40], "", None, "one", "a a a b a b"]
    got = quality.scores_of(pa.array(rows), weights)
    for text, score in zip(rows, got):
        column = arrays.text_array(pa.array([text]))
        hashes = arrays.tokens(*arrays.slice_bytes(column, 0, 1), marks=True).hashes
        place = lambda h: int(h) >> (64 - quality.BITS)
        total, count = 0.0, 0
        for i, h in enumerate(hashes):
            total, count = total + weights[place(h)], count + 1
            if i:
                pair = arrays.mix(hashes[i - 1 : i] * np.uint64(0x9FB21C651E98DF25) + hashes[i : i + 1])[0]
                total, count = total + weights[place(pair)], count + 1
            for gap in range(1, quality.REPEATS + 1):
                if i >= gap and hashes[i - gap] == h:
                    total += weights[place(arrays.mix(np.array([gap], np.uint64))[0])]
        want = 1 / (1 + np.exp(-np.clip(total * quality.SCALE / max(count, 1) + weights[-1], -35, 35)))
        assert abs(want - score) < 1e-4


def test_quality_held_out(spark):
    rows = quality.op1_quality_classifier(spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = rows.join(labels, "doc_id").where("held_out").collect()
    assert len(held) > 500 and sum(r["predicted"] == r["quality"] for r in held) / len(held) > 0.98
    assert all(r["predicted"] for r in held if r["quality"] == 1)


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "lang")
    held = language.op7_language_id(spark, "/root/testdata/sf0.1").join(docs, "doc_id").where("held_out and lang is not null").collect()
    assert len(held) > 1000 and sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.99


def test_language_profiles_by_hand(spark):
    first, second, third = language._letter_vectors()
    symbol = lambda c: 0 if not c.isalpha() else ord(c.lower()) - 96
    text, other = "Ab, cab", "zz y"

    def bundle(t):
        s = [0, *map(symbol, t), 0]
        return sum((first[s[i - 1]] * second[s[i]] * third[s[i + 1]] for i in range(1, len(s) - 1) if s[i]), np.zeros(language.DIMENSIONS))

    rows = spark.createDataFrame([(1, text, "one"), (2, other, "two"), (3, None, "two")], "doc_id long, text string, lang string")
    learnt = language.learn(rows)
    assert np.array_equal(learnt["one"], bundle(text)) and np.array_equal(learnt["two"], bundle(other))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(rows, learnt).collect()}
    assert got[1][0] == "one" and abs(got[1][1] - 1) < 1e-5 and got[2][0] == "two" and got[3] == ("und", 0.0)


def test_schedule_is_longest_first():
    sizes = [("a", 7), ("b", 5), ("c", 4), ("d", 3), ("e", 3)]
    assert sharding.schedule(sizes, 2) == {"a": 0, "b": 1, "c": 1, "d": 0, "e": 1}


def test_shards_are_even_and_groups_whole(spark, folder, texts):
    rows = sharding.op8_lpt_shards(spark, folder).collect()
    assert {r["doc_id"] for r in rows} == set(texts) and len(rows) == len(texts)
    loads = collections.Counter()
    home = {}
    for r in rows:
        text = texts[r["doc_id"]]
        assert r["size"] == len(text.encode()) + 8 and r["text_crc32"] == zlib.crc32(text.encode())
        assert home.setdefault(text, r["shard"]) == r["shard"]
        loads[r["shard"]] += r["size"]
    groups = collections.Counter()
    for r in rows:
        groups[texts[r["doc_id"]]] += r["size"]
    # The rule's own bound: no shard is fuller than the mean by more than the largest group.
    assert max(loads.values()) <= sum(loads.values()) / 24 + max(groups.values())


def test_packed_ids(spark, folder, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in packing.op4_curve_packing(spark, folder).collect():
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(pieces) == set(texts)
    for doc, found in pieces.items():
        ids = np.array(tokenizer.encode(texts[doc], add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for r in sorted(found, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for found in sequences.values():
        at = 0
        for r in sorted(found, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048 and at & (at - 1) == 0


def test_encoder_matches_the_files_own_library():
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    odd = ["", " ", "  a  b ", "é è x\n\n z", "don't 'll", "<|endoftext|> a", "　x \t q", "a\x85 b\x1c", "😀 1 22 3,4 $%& é", "naïve café", "\x00\x7f"]
    ids, bounds = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json")).encode(odd)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [own.encode(t, add_special_tokens=False).ids for t in odd]


def test_added_tokens_get_their_ids(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    odd = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x\n<|endoftext", "é<|endoftext|>  é", "plain"]
    ids, bounds = packing._encoder(path).encode(odd)
    want = [own.encode(t, add_special_tokens=False).ids for t in odd]
    assert 50256 in want[0] and [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == want
    rows = packing.pack(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string"), path).collect()
    assert {r["doc_id"]: r["doc_tokens"] for r in rows} == {i: len(w) + 1 for i, w in enumerate(want)}


def test_hilbert_curve_visits_every_cell_by_single_steps():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = packing.hilbert_keys(cells, 3)
    assert sorted(keys.tolist()) == list(range(512))
    assert np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1).max() == 1


def near_copies(seed=5):
    """Families of edited copies, texts that share a passage only, and strangers."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 7)))
    passage = [word() for _ in range(30)]
    rows = []
    for family in range(12):
        base = [word() for _ in range(rng.randint(20, 120))]
        for _ in range(rng.randint(1, 9) if family else 60):
            copy = list(base)
            for _ in range(rng.randint(0, len(base) // 40 + 1)):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
    rows += [" ".join(passage + [word() for _ in range(40)]) for _ in range(20)]
    rows += [rows[0], rows[0].upper() + "!", "a b c", "a b c", ""]
    return [(i * 3 + 1, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("block", [8, ngramjoin.BLOCK_ROWS])
def test_jaccard_join(spark, monkeypatch, block):
    monkeypatch.setattr(ngramjoin, "BLOCK_ROWS", block)  # small blocks: components larger than one
    rows = near_copies()
    sets = []
    for _, text in rows:
        words = WORD.findall(text.lower())
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9]
    assert len(pairs) > 500
    linked = collections.Counter(x for p in pairs for x in p)
    found = roots(len(rows), pairs)
    want = {doc: (rows[found[i]][0], linked[i], found[i] == i) for i, (doc, _) in enumerate(rows)}
    got = {r["doc_id"]: (r["class_id"], r["n_links"], r["kept"]) for r in ngramjoin.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_pruning_keeps_pairs_at_the_threshold():
    assert [ngramjoin.least_matches(n) for n in (16, 64, 128)] == sorted(ngramjoin.least_matches(n) for n in (16, 64, 128))
    rng = np.random.default_rng(0)
    agree = rng.random((20_000, ngramjoin.HASHES)) < 0.8
    lost = np.zeros(len(agree), bool)
    for n in range(ngramjoin.STEP, ngramjoin.HASHES + 1, ngramjoin.STEP):
        lost |= agree[:, :n].sum(1) < ngramjoin.least_matches(n)
    assert lost.mean() < 0.005


def distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        fresh = [i]
        for j, b in enumerate(text, 1):
            fresh.append(min(row[j] + 1, fresh[-1] + 1, row[j - 1] + (a != b)))
        row = fresh
    return min(row)


def test_bit_parallel_distance():
    rng = random.Random(1)
    for _ in range(400):
        pattern, text = [rng.randrange(4) for _ in range(rng.randint(1, 80))], [rng.randrange(4) for _ in range(rng.randint(0, 30))]
        assert decontamination.distance_within(pattern, text) == distance(pattern, text)


def test_contaminations(spark, folder, texts):
    """Edited passages at every distance up to the limit, and one beyond it."""
    rng = random.Random(4)
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()}
    spare = [w for t in list(texts.values())[:30] for w in WORD.findall(t.lower())]
    rows, want, parsed = [], set(), {i: WORD.findall(t.lower()) for i, t in items.items()}
    for item, words in parsed.items():
        for edits in range(0, int(len(words) * decontamination.MAX_EDITS) + 2):
            passage = list(words)
            for place in rng.sample(range(1, len(words) - 1), edits):
                passage[place] = rng.choice(spare) + "q"
            rows.append((len(rows), " ".join(rng.choices(spare, k=25) + passage + rng.choices(spare, k=25))))
    for doc, text in rows:
        words = WORD.findall(text)
        want |= {(doc, item, d) for item, p in parsed.items() if len(set(p) & set(words)) > len(p) / 3 and (d := distance(p, words)) <= int(len(p) * decontamination.MAX_EDITS)}
    got = {
        (r["doc_id"], r["item_id"], r["edits"])
        for r in decontamination.contaminations(spark.createDataFrame(rows, "doc_id long, text string"), spark.read.parquet(f"{folder}/benchmark.parquet")).collect()
    }
    assert got <= want and len(got) >= 0.995 * len(want)


@pytest.mark.parametrize("kind", ["delete", "insert", "change", "mixed"])
def test_every_edited_copy_is_found(kind):
    rng = random.Random(6)
    items = [(n, [f"w{n}x{i}" for i in range(n)]) for n in (8, 10, 25, 59, 100, 200, 400) for _ in range(1)]
    index = decontamination.ItemIndex([(n, " ".join(w)) for n, w in items])
    rows, want = [], []
    for turn in range(8):
        for number, (n, words) in enumerate(items):
            passage = list(words)
            for place in sorted(rng.sample(range(n), n // 5), reverse=True):
                how = rng.choice(["delete", "insert", "change"]) if kind == "mixed" else kind
                passage[place : place + 1] = {"delete": [], "insert": [passage[place], "new"], "change": ["other"]}[how]
            rows.append(" ".join(["front"] * 9 + passage + ["back"] * 9))
            want.append((len(rows) - 1, number, distance(words, rows[-1].split())))
    assert list(decontamination._found(index, pa.array(rows))) == want


def test_short_and_unspaced_items_are_found():
    items = [(0, "who wrote hamlet"), (1, "which river runs through old paris"), (2, "中国的首都是哪里？"), (3, "ประเทศไทย"), (4, "... !")]
    index = decontamination.ItemIndex(items, min_words=1)
    texts = ["so who wrote Hamlet?", "who then wrote hamlet", "which river flows through old paris", "一二三，中国的首都是哪里呢", "中国首都是哪里", "ใน ประเทศไทยนี้", "which river"]
    assert [(r, i, e) for r, i, e in decontamination._found(index, pa.array(texts))] == [(0, 0, 0), (2, 1, 1), (3, 2, 0), (4, 2, 1), (5, 3, 0)]
    column = arrays.text_array(pa.array(["日本語、テスト abc日x", "é ü", "日"]))
    assert np.diff(arrays.tokens(*arrays.slice_bytes(column, 0, 3)).bounds).tolist() == [9, 2, 1]


def test_every_exact_passage_is_found(spark, folder, texts):
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()}
    want = {(d, i) for d, t in texts.items() for i, x in items.items() if x in t}
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.op5_cgk_decontamination(spark, folder).collect()}
    assert want <= got


@pytest.mark.parametrize("block", [16, vectors.BLOCK_ROWS])
def test_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", block)
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((12, 24))
    rows = np.concatenate([c + 0.16 * rng.standard_normal((n, 24)) for c, n in zip(centres, [90, 30, 5, 5, 2, 2, 2, 1, 1, 1, 1, 1])] + [rng.standard_normal((200, 24))])
    rows = np.concatenate([rows, rows[:3]]).astype(np.float32)
    unit = rows.astype(float) / np.linalg.norm(rows.astype(float), axis=1)[:, None]
    near = unit @ unit.T >= vectors.THRESHOLD
    np.fill_diagonal(near, False)
    found = roots(len(rows), [(int(a), int(b)) for a, b in zip(*np.nonzero(near)) if a > b])
    table = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_duplicates(table).collect()}
    assert near.sum() > 1000 and got == {i: (int(near[i].sum()), found[i]) for i in range(len(rows))}


@pytest.mark.parametrize("exact,window", [(vectors.EXACT_ROWS, 64), (200, 8)])
def test_isolated_pairs_in_a_hot_cluster(spark, monkeypatch, exact, window):
    monkeypatch.setattr(vectors, "EXACT_ROWS", exact)
    monkeypatch.setattr(vectors.projection_links, "__defaults__", (window, None, 0))
    monkeypatch.setattr(vectors, "WINDOW", window)
    rng = np.random.default_rng(4)
    count, pairs, size = (12000, 300, 64) if window == 64 else (3000, 200, 32)
    centre = np.eye(size)[0]
    around = rng.standard_normal((count, size)) * (centre == 0)
    rows = np.sqrt(0.88) * centre + np.sqrt(0.12) * around / np.linalg.norm(around, axis=1)[:, None]
    turned = rng.standard_normal((pairs, size))
    turned -= (turned * rows[:pairs]).sum(1)[:, None] * rows[:pairs]
    turned /= np.linalg.norm(turned, axis=1)[:, None]
    rows = np.concatenate([rows, 0.951 * rows[:pairs] + np.sqrt(1 - 0.951**2) * turned])
    table = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in vectors.near_duplicates(table).collect()}
    near = (rows[count:] @ rows.T >= vectors.THRESHOLD).sum(1) - 1
    assert (near > 0).all() and np.mean([got[count + i] == n for i, n in enumerate(near)]) >= 0.985


def test_components(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(150)] + [(500, 500)]
    want = roots(501, pairs)
    nodes = {x for a, b in pairs if a != b for x in (a, b)}
    got = {r["node"]: r["root"] for r in links.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {n: want[n] for n in nodes}


def test_read_foreign_packages(spark, tmp_path):
    """A package of another writer: a comment, deflated side members, an index in two parts, 64-bit and plain entries."""
    bodies = {f"{i}": (f"page {i} " * 50).encode() for i in range(6)}
    packed, lines, offset = b"", [], 0
    import hashlib

    for name, body in bodies.items():
        one = zlib.compressobj(6, zlib.DEFLATED, 31)
        raw = archives.record(name, f"http://x/{name}%", body, hashlib.sha1(body).digest(), None)
        piece = one.compress(raw) + one.flush()
        lines.append(f"k{name} 2024 {json.dumps({'offset': str(offset), 'length': str(len(piece)), 'filename': 'archive/data.warc.gz'})}\n")
        packed, offset = packed + piece, offset + len(piece)
    path = str(tmp_path / "a.wacz")
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("datapackage.json", "{}" * 500, zipfile.ZIP_DEFLATED)
        with z.open(zipfile.ZipInfo("archive/data.warc.gz"), "w", force_zip64=True) as member:
            member.write(packed)
        z.writestr("indexes/a.cdxj", "".join(lines[:4]))
        z.writestr("indexes/b.cdxj", "".join(lines[4:]).rstrip("\n"))
        z.comment = b"a comment"
    got = {r["page"]: (bytes(r["payload"]), r["url"]) for r in archives.read_packages(spark.createDataFrame([(path,)], "path string")).collect()}
    assert got == {n: (b, f"http://x/{n}%") for n, b in bodies.items()}


def test_zip64_end_record(tmp_path):
    """Fields that overflow 32 bits are read from the ZIP64 records."""
    import struct

    import pyarrow.fs

    data = b"hello"
    local = struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 1, 20) + b"a" + struct.pack("<HHQQ", 1, 16, 5, 5) + data
    extra = struct.pack("<HHQQQ", 1, 24, 5, 5, 0)
    central = struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 1, len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + b"a" + extra
    end64 = struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, 1, 1, len(central), len(local))
    locator = struct.pack("<IIQI", 0x07064B50, 0, len(local) + len(central), 1)
    end = struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    path = tmp_path / "wide.zip"
    path.write_bytes(local + central + end64 + locator + end)
    with pyarrow.fs.LocalFileSystem().open_input_file(str(path)) as source:
        (member,) = archives.central_directory(source)
        assert member == archives.Member("a", True, len(local) - 5, 5) and source.read_at(member.size, member.offset) == data


def test_broken_packages_fail(tmp_path):
    import pyarrow.fs

    (tmp_path / "no.zip").write_bytes(b"not a package")
    with pyarrow.fs.LocalFileSystem().open_input_file(str(tmp_path / "no.zip")) as source, pytest.raises(ValueError):
        archives.central_directory(source)


def test_benchmark_of_several_blocks(spark, monkeypatch):
    """The same findings from one block and from many, in one pass over the documents; equal items are all named."""
    words = [f"w{i}" for i in range(400)]
    pick = random.Random(4)
    items = [" ".join(pick.choices(words, k=pick.randint(3, 40))) for _ in range(60)]
    table = spark.createDataFrame([*enumerate(items), (500, items[0]), (501, items[0]), (None, items[1])], "item_id long, text string")
    texts = [" ".join(pick.choices(words, k=100)) + " " + items[i % 60] + " " + " ".join(pick.choices(words, k=5)) for i in range(90)]
    docs = spark.createDataFrame([*enumerate([*texts, "none of it", None])], "doc_id long, text string")
    whole = sorted((tuple(r) for r in decontamination.contaminations(docs, table, min_words=1).collect()), key=repr)
    assert {(0, 0), (0, 500), (0, 501), (1, None), (1, 1)} <= {r[:2] for r in whole}
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 700)
    assert len(decontamination._blocks(table, min_words=1)) > 5
    many = decontamination.contaminations(docs, table, min_words=1)
    assert sorted((tuple(r) for r in many.collect()), key=repr) == whole and str(many._jdf.queryExecution().toString()).count("MapInArrow") <= 4
    assert sorted(r["doc_id"] for r in decontamination.clean(docs, table, min_words=1).collect()) == [90, 91]


@pytest.mark.parametrize("kind", ["delete", "insert", "change", "mixed"])
def test_sampled_recall_at_the_limit(kind):
    """Items of many lengths with as many edits as they may take, found by CGK samples of their segments."""
    pick = random.Random(31)
    items = [[f"w{n}x{i}" for i in range(n)] for n in (10, 11, 14, 19, 22, 29, 30, 45, 77, 150, 400)]
    index = decontamination.ItemIndex([(n, " ".join(w)) for n, w in enumerate(items)])
    assert index.sampled.all() and not index.segments
    rows, want = [], set()
    for turn in range(12):
        for number, words in enumerate(items):
            passage = list(words)
            for place in sorted(pick.sample(range(len(words)), len(words) // 5), reverse=True):
                how = pick.choice(["delete", "insert", "change"]) if kind == "mixed" else kind
                passage[place : place + (how != "insert")] = [] if how == "delete" else [f"new{turn}x{place}"]
            rows.append(" ".join(["front"] * 9 + passage + ["back"] * 9))
            want.add((len(rows) - 1, number))
    found = {(r, i) for r, i, _ in decontamination._found(index, pa.array(rows))}
    assert len(want - found) <= 0.01 * len(want)


def test_packages_are_read_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archives, "TASK_BYTES", 40_000)
    monkeypatch.setattr(archives, "READ_BYTES", 5_000)
    pick = random.Random(8)
    rows = [(i, f"http://h/{i}", "".join(pick.choices("abcdefghij klmnop", k=2000))) for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    found = archives.read_packages(archives.write_packages(pages, str(tmp_path / "p")))
    tasks = found.select(F.spark_partition_id().alias("t"), "page").collect()
    assert len({r["t"] for r in tasks}) >= 8 and sorted(int(r["page"]) for r in tasks) == list(range(400))
