"""Each operator against a plain computation of its own on small tables with odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from pixelloom.llm import language_id, media, mixing, near_dup, packing, pii, quality_model, quality_rules, sharding, similar_links, token_codes
from pixelloom.llm.common import new_path
from pixelloom.llm.tokens import encoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, Score double"


def made(n: int = 120) -> list[tuple]:
    draw = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta"]
    rows = []
    for i in range(n):
        text = " ".join(draw.choice(words) + draw.choice(["", ".", ","]) for _ in range(draw.randint(1, 150)))
        rows.append((i, text, draw.choice(["aa", "bb", None]), draw.choice(["s1", "s2", None]), len(text), 1, 0.5))
    rows += [(n, None, None, None, None, None, None), (n + 1, "", "aa", "s1", 0, 1, 1.0), (None, "no id at all", None, "s1", 1, 1, 1.0), (7, rows[7][1], "aa", "s1", 1, 1, 1.0), rows[3]]
    rows += [(n + 2, "x" * 70_000 + " y\n" * 9000, "bb", "s3", 1, 1, 1.0), (n + 3, "Grüße  aus   Köln\t@ + 1.2.3.4 ", "bb", "s3", 1, 1, 1.0)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(made(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_ids(text, name):
    return [*encoder(name).whole(text or ""), 1]


def test_token_codes_round_trip(spark, docs, empty):
    path = new_path(spark, "codes")
    token_codes.write_token_codes(docs, path)
    got = sorted(((r["start"], r["doc_id"], list(r["ids"])) for r in token_codes.read_token_codes(spark, path).collect()))
    rows = sorted(made(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at = 0
    for (start, doc_id, ids), row in zip(got, rows, strict=True):
        assert (start, doc_id, ids) == (at, row[0], brute_ids(row[1], "word_bpe_49k.json"))
        at += len(ids)
    flat = [x for _, _, ids in got for x in ids]
    places = [0, 1, len(flat) // 2, len(flat) - 1, len(flat)]
    found = {r["position"]: r["id"] for r in token_codes.tokens_at(spark.createDataFrame([(p,) for p in places], "position long"), path).collect()}
    assert found == {p: flat[p] if p < len(flat) else None for p in places}
    token_codes.write_token_codes(empty, none := new_path(spark, "codes"))
    assert token_codes.read_token_codes(spark, none).count() == 0


def test_codes_read_any_token():
    draw = np.random.default_rng(1)
    ids = np.concatenate([draw.integers(0, 300, 2000), draw.integers(0, 1 << 24, 1500), [0, 255, 256, 65535, 65536]]).astype(np.uint32)
    codes = token_codes.Codes(token_codes.Codes.write(ids))
    assert codes.slice(0, len(ids)).tolist() == ids.tolist()
    for i in draw.integers(0, len(ids), 200):
        assert codes.token(int(i)) == ids[i]
        assert codes.slice(int(i), min(len(ids), int(i) + 37)).tolist() == ids[i : i + 37].tolist()


def test_packing_keeps_every_id_once(docs, empty):
    got = packing.pack(docs, 64).collect()
    by_sequence, by_doc = {}, {}
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] <= 64
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), {}).setdefault(r["start"], []).append(ids.tolist())
    for places in by_sequence.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 64
    for doc_id, text, *_ in made():
        ids = brute_ids(text, "byte_bpe_50k.json")
        pieces = by_doc[doc_id, len(ids)]
        assert [x for s in sorted(pieces) for x in pieces[s][0]] == ids
    assert packing.pack(empty).count() == 0


def test_first_fit_decreasing_is_first_fit():
    draw = random.Random(2)
    for _ in range(100):
        sizes = [draw.randint(1, 20) for _ in range(draw.randint(0, 60))]
        bins, want = [], {}
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            k = next((k for k, b in enumerate(bins) if b + sizes[i] <= 20), len(bins))
            if k == len(bins):
                bins.append(0)
            want[i] = (k, bins[k])
            bins[k] += sizes[i]
        assert packing.first_fit_decreasing(sizes, 20) == [want[i] for i in range(len(sizes))]


def brute_pii(t: str):
    rules = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    for k, rule in rules.items():
        for m in re.finditer(rule, t):
            d = re.sub("[^0-9]", "", m[0])
            if k == "ip":
                fits = all(pii.small(x) for x in m[0].split("."))
            else:
                fits = {"email": True, "card": 12 <= len(d) <= 19 and pii.luhn(d), "phone": 9 <= len(d) <= 15}[k]
            if fits:
                yield m.start(), m.end(), k


def test_personal_data_equals_the_rules():
    draw = random.Random(1)
    kinds = ["1", "2.", ".3", "255", ".", " ", "-", "+4", "@a", "a.b", "300", "4111111111111111", "(", ")", "é", "x@y.z", "\n", "000"]
    for _ in range(20_000):
        t = "".join(draw.choice(kinds) for _ in range(draw.randint(0, 25)))
        got = [s for s in pii.spans(t) if s[2] in pii.KINDS[:4]]
        assert got == sorted(brute_pii(t), key=lambda s: (s[0], pii.KINDS.index(s[2]))), t


def test_personal_data_added_and_redacted(docs, empty):
    text = "see https://a.example.com/x?y=1. account no: DE44 5001 0517 5407 3249 31 and mail me@b.org"
    assert [k for _, _, k in pii.spans(text)].count("url") == 1
    assert pii.redacted("mail me@b.org now") == "mail <EMAIL> now"
    assert pii.redacted(None) is None and pii.spans("") == []
    got = pii.find_personal_data(docs).collect()
    assert len(got) == len(made()) and pii.find_personal_data(empty).count() == 0
    assert {r["base_sha256"] for r in got if r["doc_id"] == 120} == {hashlib.sha256(b"").hexdigest()}


def test_mixing_meets_targets(docs, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == len(made())
    total = sum(len((t or "").split()) for _, t, *_ in made())
    by = {}
    for r in got:
        by.setdefault(r["source"], []).append(r)
    assert abs(sum(rs[0]["target"] for rs in by.values()) - sum(r["size"] for r in got)) < 1e-6 and total
    for rs in by.values():
        assert rs[0]["target"] <= 3 * rs[0]["source_size"] + 1e-9
        assert all(0 <= r["copies"] <= 3 for r in rs)
        sizes = {}
        for r in rs:
            sizes[r["doc_id"], r["size"]] = sizes.get((r["doc_id"], r["size"]), 0) + r["size"]
        assert abs(sum(r["size"] * r["copies"] for r in rs) - rs[0]["target"]) <= max(sizes.values()) / 2 + 1e-6
    assert mixing.mix(empty).count() == 0
    copies = sum(r["copies"] for r in got)
    assert mixing.mixed_documents(docs).count() == copies


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(fps))]


def test_simhash_groups_equal_brute_force(docs, empty):
    got = near_dup.groups(docs).collect()
    want_fps = [brute_fingerprint(t) for _, t, *_ in made()]
    want = sorted((str(r[0]), f, c) for r, f, c in zip(made(), want_fps, brute_components([r[0] for r in made()], want_fps), strict=True))
    assert sorted((str(r["doc_id"]), r["fp"] % (1 << 64), r["component_id"]) for r in got) == want
    assert near_dup.groups(empty).count() == 0
    assert near_dup.one_of_each(docs).where("doc_id IS NOT NULL").count() == len({c for _, _, c in want if c is not None})


@pytest.mark.parametrize("bucket", [1, 64])
def test_links_lose_no_component(spark, monkeypatch, bucket):
    monkeypatch.setattr(near_dup, "BUCKET", bucket)
    draw = random.Random(4)
    fps = {draw.getrandbits(64) for _ in range(150)}
    for f in list(fps)[:60]:
        for _ in range(4):
            f ^= 1 << draw.randrange(64) | 1 << draw.randrange(64)
            fps.add(f)
    fps = sorted(fps)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    distinct = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    of = {r["node"] % (1 << 64): r["root"] for r in near_dup.components(near_dup.links(distinct)).collect()}
    groups, want = {}, {}
    for f, c in zip(fps, brute_components(list(range(len(fps))), fps), strict=True):
        want.setdefault(c, set()).add(f)
        groups.setdefault(of.get(f, f"alone {f}"), set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_media_round_trip(spark, docs, empty):
    path = new_path(spark, "media")
    media.store(docs, path)
    got = media.read_back(spark, path).collect()
    assert len(got) == len(made())
    want = sorted((str(d), *media.payload(t)) for d, t, *_ in made())
    for r, (d, raw, n) in zip(sorted(got, key=lambda r: (str(r["doc_id"]), r["n_bytes"])), sorted(want, key=lambda w: (w[0], w[2])), strict=True):
        assert (str(r["doc_id"]), r["n_bytes"], r["payload_bytes"]) == (d, n, len(raw))
        assert r["payload_sha256"] == hashlib.sha256(raw).hexdigest() and r["tail_crc32"] == zlib.crc32(raw[-32:])
    texts = {hashlib.sha256(media.payload(t)[0]).hexdigest(): (t or "").encode() for _, t, *_ in made()}
    assert {r["payload_sha256"]: bytes(r["payload"]) for r in media.payloads(spark, path).collect()} == texts
    assert media.stored_and_read(empty).count() == 0


def test_chunks_follow_content():
    draw = np.random.default_rng(2)
    a = draw.integers(0, 256, 60_000, dtype=np.uint8).tobytes()
    first, second = media.chunks(a), media.chunks(b"inserted" + a)
    assert b"".join(p for _, p in first) == a
    assert len({d for d, _ in first} & {d for d, _ in second}) > len(first) / 2


def brute_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    three = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(three) if three.count(w) > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)


def test_quality_rules(docs, empty):
    for t in ["", None, "a b c a b c", "x\nx\n y\n\n\nx", "a|b <c> ##\n \n \n", *[r[1] for r in made(20)[:20]]]:
        got = quality_rules.base_statistics(t)
        assert tuple(got[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute_statistics(t)
    got = quality_rules.judge(docs).collect()
    assert len(got) == len(made())
    assert not any(r["kept"] for r in got if r["n_words"] < 50)
    assert quality_rules.judge(empty).count() == 0


def test_sharding_is_a_permutation(docs, empty):
    got = sharding.shard(docs).collect()
    n = len(made())
    assert sorted(r["place"] for r in got) == sorted(r["row_number"] for r in got) == list(range(n))
    counts = [sum(r["shard"] == s for r in got) for s in range(8)]
    assert sum(counts) == n and max(counts) - min(counts) <= 1
    assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s])) for s in range(8))
    assert sharding.shard(empty).count() == 0


def test_language_is_found(spark, empty):
    draw = random.Random(1)
    text = {"aa": ["the", "that", "with", "thing", "other"], "bb": ["der", "nicht", "schon", "ich", "auch"]}
    rows = [(i, " ".join(draw.choice(text[k]) for _ in range(20)), k, "s", 0, 0, 0.0) for i in range(60) for k in [draw.choice(["aa", "bb"])]]
    docs = spark.createDataFrame([*rows, (99, None, None, None, None, None, None), (98, "12 !!", "aa", "s", 1, 1, 1.0)], SCHEMA)
    model = language_id.train(docs, held_out=language_id.held_out())
    got = {r["doc_id"]: r for r in language_id.identify(docs, model).collect()}
    assert all(got[r[0]]["lang_pred"] == r[2] and 0 <= got[r[0]]["score"] <= 1 for r in rows)
    assert got[99]["lang_pred"] == got[98]["lang_pred"] == "und"
    assert language_id.identify(empty, language_id.train(empty)).count() == 0


def test_forward_sums_all_segmentations():
    pieces = language_id.Pieces("piece_bpe_32k.model")
    draw = np.random.default_rng(1)
    p = np.concatenate([draw.random((len(pieces.names), 1)), [[language_id.UNKNOWN], [0.0]]])
    at = {n: i for i, n in enumerate(pieces.names)}

    def brute(word):
        if not word:
            return 1.0
        return sum((p[at[word[:k]], 0] if word[:k] in at else language_id.UNKNOWN if k == 1 else 0.0) * brute(word[k:]) for k in range(1, len(word) + 1))

    words = ["▁the", "▁winter", "▁ß", "abc"]
    lengths, found = pieces.found(words)
    got = language_id.forward(lengths, found, p)[np.arange(4), lengths, 0]
    assert np.allclose(got, [brute(w) for w in words])


def test_quality_model_learns(spark, docs, empty):
    rows = [(i, ("good words here " if i % 2 else "BUY!! now %%% ") * 10, None, None, 0, 0, 0.0) for i in range(80)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(80)], "doc_id long, quality int, toxic int")
    own = spark.createDataFrame(rows, SCHEMA)
    model = quality_model.train(own, labels)
    got = {r["doc_id"]: r for r in quality_model.score(own, model).collect()}
    assert all(got[i]["predicted"] == i % 2 for i in range(80))
    assert all(0 <= r["score"] <= 1 for r in quality_model.score(docs, model).collect())
    assert quality_model.score(empty, quality_model.train(empty, labels.limit(0))).count() == 0


def _five_words(text):
    words = (text or "").encode().lower().split()
    k = min(5, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


@pytest.mark.parametrize("local", [0, 1 << 18])
def test_components_are_the_same_on_the_driver_and_in_rounds(spark, monkeypatch, local):
    monkeypatch.setattr(near_dup, "LOCAL", local)
    rounds, join = [], near_dup.salted_join
    monkeypatch.setattr(near_dup, "salted_join", lambda *x: rounds.append(1) or join(*x))
    draw = random.Random(2)
    chain = list(range(-40, 0))
    draw.shuffle(chain)
    edges = [*zip(chain, chain[1:], strict=False), *((draw.randrange(200), draw.randrange(200)) for _ in range(90)), (500, 500), (1 << 62, -(1 << 63))]
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    got = near_dup.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted((r["node"], r["root"]) for r in got) == sorted(root.items())
    assert bool(rounds) == (local == 0)


def test_similar_texts_are_one_group(spark):
    draw = random.Random(8)
    made_texts = []
    for _ in range(25):
        base = [f"w{draw.randrange(5000)}" for _ in range(draw.choice([3, 60, 300]))]
        for edits in (0, 0, 1, 2, 4, 8):
            text = list(base)
            for _ in range(edits):
                text[draw.randrange(len(text))] = f"new{draw.randrange(10**6)}"
            made_texts.append(" ".join(text))
    made_texts += [None, "", " \n", made_texts[0].upper()]
    rows = list(enumerate(made_texts, start=10))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dup.groups(docs, similarity=0.8).collect()}
    fps, sets = [brute_fingerprint(t) for _, t in rows], [_five_words(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            alike = sets[i] and sets[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])
            if alike or (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert got == {d: rows[find(i)][0] for i, (d, _) in enumerate(rows)}


def _split_pairs(spark, texts, least=0.8):
    """How many pairs of so similar texts there are, and how many of them the groups set apart; SimHash links too."""
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    group = {r["doc_id"]: r["component_id"] for r in near_dup.groups(docs, similarity=least).collect()}
    sets = [_five_words(t) for t in texts]
    at = {s: i for i, s in enumerate(sorted(set().union(*sets)))}
    has = np.zeros((len(texts), len(at)), dtype=np.float32)
    for i, own in enumerate(sets):
        has[i, [at[s] for s in own]] = 1
    shared, size = has @ has.T, has.sum(axis=1)
    alike = np.triu(10 * shared >= 10 * least * (size[:, None] + size[None, :] - shared) - 1e-6, 1)
    pairs = np.argwhere(alike)
    return len(pairs), sum(group[i] != group[j] for i, j in pairs.tolist())


def test_large_group_that_one_text_holds_together(spark, monkeypatch):
    monkeypatch.setattr(similar_links, "MOST", 64)
    draw = random.Random(3)
    base = [f"w{k}" for k in range(500)]
    texts = [" ".join(base)]
    for c in range(3000):
        text = list(base)
        for k in draw.sample(range(0, 500, 6), 8):
            text[k] = f"new{c}x{k}"
        texts.append(" ".join(text))
    pairs, split = _split_pairs(spark, texts)
    assert pairs >= 3000 and split == 0


def test_variants_of_a_template_on_both_sides_of_the_limit(spark):
    draw = random.Random(9)
    base = [f"w{k}" for k in range(200)]
    texts = []
    for c in range(300):
        text = list(base)
        for k in draw.sample(range(0, 200, 5), 3):
            text[k] = f"new{c}x{k}"
        texts.append(" ".join(text))
    pairs, split = _split_pairs(spark, texts)
    assert 100 < pairs < 40_000 and split == 0


def test_blocks_of_a_large_group_grow_with_its_texts(spark, monkeypatch):
    """Variants of one template share most bands, and near the limit many stay outside the largest group."""
    monkeypatch.setattr(similar_links, "MOST", 128)
    met, reach = [], similar_links.in_reach
    monkeypatch.setattr(similar_links, "in_reach", lambda dealt, *rest: met.append(dealt.count()) or reach(dealt, *rest))
    draw = random.Random(9)
    base = [f"w{k}" for k in range(200)]
    texts = []
    for c in range(1200):
        text = list(base)
        for k in draw.sample(range(0, 200, 5), 4):
            text[k] = f"new{c}x{k}"
        texts.append(" ".join(text))
    pairs, split = _split_pairs(spark, texts)
    assert pairs > 100 and split == 0
    assert sum(met) < 2 * 32 * len(texts), met  # a text has 32 bands


def test_blocks_read_in_parts_have_all_links(spark):
    """A block of several Arrow batches, with texts of one side and of both."""
    draw = np.random.default_rng(6)
    n, words = 700, 60
    sets = [np.unique(np.concatenate([np.arange(words)[draw.random(words) < 0.93], 1000 * i + draw.integers(100, 900, 3)])) for i in range(n)]
    side = draw.choice([1, 2, 3], n)
    batch = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        met = spark.createDataFrame([(5, 0, 0, int(s), i, 10 + i) for i, s in enumerate(side)], "key long, p int, q int, side int, class long, grp long")
        own = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(sets)], "class long, set array<long>")
        got = [(r["a"], r["b"]) for r in similar_links.verified(met, own, 0.8).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    of = {i: set(x.tolist()) for i, x in enumerate(sets)}
    want = [(10 + i, 10 + j) for i in range(n) if side[i] & 1 for j in range(n) if side[j] & 2 and i != j and 10 * len(of[i] & of[j]) >= 8 * len(of[i] | of[j])]

    def parts(links):
        root = {10 + i: 10 + i for i in range(n)}

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in links:
            root[find(a)] = find(b)
        return [find(10 + i) for i in range(n)]

    met, true = parts(got), parts(want)
    assert len(set(zip(met, true, strict=True))) == len(set(met)) == len(set(true)) and 1 < len(set(true)) < n


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_those_of_the_library_for_special_strings(name):
    from tokenizers import Tokenizer

    from pixelloom.llm.tokens import vocabulary_path

    plain = Tokenizer.from_file(vocabulary_path(name))
    parts = ["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|end", "oftext|>", "a", "word", " ", "  ", "\n", "\n\n ", "é"]
    draw = random.Random(6)
    texts = ["<|endoftext|>", "a <|endoftext|> b", "x\n\n <|endoftext|>\n y<|startoftext|>z", *["".join(draw.choice(parts) for _ in range(draw.randint(1, 12))) for _ in range(3000)]]
    for t, ids in zip(texts, encoder(name).batch(texts), strict=True):
        assert ids.tolist() == plain.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_those_of_the_library_wherever_units_are_cut(name, monkeypatch):
    from pixelloom.llm.tokens import Encoder

    enc = Encoder(name)
    monkeypatch.setattr(Encoder, "BYTES", 64)
    monkeypatch.setattr(Encoder, "UNITS", 5)
    parts = ["a", "Word", "H", "\u0331", "\u0301", "\u0338", "<", "'", "'s", "'RE", "n't", "5", "12", "_", ".", "$$", " ", "  ", "\n", "\r\n ", "\t", "\x00", "\x01", "\x1c", "\x85", "\xa0", "\u2003", "\u3000", "é", "İ", "ß", "Σ", "你", "\u1112", "\u1161", "“", "<|endoftext|>", "<|ENDOFTEXT|>", "<|end", "oftext|>"]
    draw = random.Random(8)
    texts = [None, "", "<|endof", "text|>", "'", "s x", *["".join(draw.choice(parts) for _ in range(draw.randrange(12))) for _ in range(4000)]]
    want = [enc.whole(t or "") for t in texts]
    assert [x.tolist() for x in enc.batch(texts)] == want
    got = [x.tolist() for ids, counts in enc.column(pa.array(["before", *texts])[1:]) for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == want
    assert enc.batch([]) == [] == list(enc.column(pa.array([], pa.string())))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_the_tokenizer_gets_a_word_once_whatever_signs_stand_beside_it(name):
    from pixelloom.llm.tokens import Encoder

    enc, words = Encoder(name), [f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    texts = [f"{w}{sign}" for sign in (",", ".", "!!", "...", ";", "'s", "$$$", "5") for w in words]
    assert [x.tolist() for x in enc.batch([" ".join(texts)])] == [enc.whole(" ".join(texts))]
    assert len(enc.seen) <= len(words) + 1 + 8


def test_a_tokenizer_that_cuts_otherwise_gets_whole_texts(tmp_path):
    from tokenizers import Tokenizer, pre_tokenizers

    from pixelloom.llm.tokens import Encoder, vocabulary_path

    plain = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    assert Encoder("byte_bpe_50k.json").known and Encoder("word_bpe_49k.json").known
    plain.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    plain.save(str(tmp_path / "other.json"))
    texts = ["(a word, don't", None, "in  the\nend", "", "a.b" * 9]
    assert [x.tolist() for x in Encoder(str(tmp_path / "other.json")).batch(texts)] == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_cues_are_found_in_any_case():
    for cue in ("Customer ID: 12345678", "User ID 123456", "customer ID: 12345678", "Member ID 12345678", "iBAN: DE44500105175407324931"):
        for before in ("", "Größe İ "):
            found = [s for s in pii.spans(before + cue) if s[2] == "account"]
            assert len(found) == 1 and (before + cue)[found[0][0] : found[0][1]] == cue.split(" ")[-1], cue


def test_rows_without_an_id_are_deduplicated(spark):
    texts = [" ".join(f"{x}{k}" for k in range(40)) for x in "abc"]
    rows = [(1, texts[0]), (None, texts[0]), (None, texts[1]), (None, texts[1]), (None, texts[1].upper()), (None, texts[2]), (5, "other words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["text"]) for r in near_dup.one_of_each(docs, similarity=0.8).collect())
    assert got == sorted([("1", texts[0]), ("None", texts[1].upper()), ("None", texts[2]), ("5", "other words")])


def test_a_full_cache_starts_anew_and_holds_a_batch(monkeypatch):
    from pixelloom.llm.tokens import Encoder

    enc = Encoder("byte_bpe_50k.json")
    monkeypatch.setattr(Encoder, "MOST", 3)
    draw = random.Random(4)
    for _ in range(20):
        texts = [" ".join(f"w{draw.randrange(60)}" for _ in range(40)) for _ in range(3)]
        assert [x.tolist() for x in enc.batch(texts)] == [enc.whole(t) for t in texts]
    assert len(enc.seen) <= 3 + 200


def test_documents_alone_stay_whatever_bits_their_ids_share(spark):
    """1 and 2 are copies; other ids have the bits of 1, or are negative, or stand for two texts."""
    far = 1 + (1 << 26)
    rows = [(1, "red green blue black"), (2, "red green blue black"), (far, "one two three four five"), (-7, "six seven eight nine ten"), (-7, "red green blue black")]
    rows += [(9, "oak elm ash fir yew"), (9, "tin zinc iron lead gold"), (11, "salt salt salt salt"), (11, "salt salt salt salt")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = sorted((r["doc_id"], r["text"]) for r in near_dup.one_of_each(docs).collect())
    want = [(-7, "red green blue black"), (-7, "six seven eight nine ten"), (9, "oak elm ash fir yew"), (9, "tin zinc iron lead gold"), (11, "salt salt salt salt"), (far, "one two three four five")]
    assert got == sorted(want)


def test_forest_holds_together_what_all_links_do():
    draw = np.random.default_rng(8)
    for n, m, k in ((0, 3, 2), (1, 1, 1), (6, 9, 4), (20, 30, 50), (40, 40, 60)):
        left, right = draw.integers(-k, k, n), draw.integers(-k, k, m)
        alike = draw.random((n, m)) < 0.04
        want = {(min(left[i], right[j]), max(left[i], right[j])) for i, j in zip(*np.nonzero(alike), strict=True) if left[i] != right[j]}
        a, b = similar_links._forest(alike, left, right)

        def parts(links):
            of = {x: x for x in [*left.tolist(), *right.tolist()]}
            for x, y in links:
                of = {z: of[int(x)] if o == of[int(y)] else o for z, o in of.items()}
            return {frozenset(z for z in of if of[z] == o) for o in of.values()}

        got = list(zip(a.tolist(), b.tolist(), strict=True))
        assert parts(got) == parts(want)
        assert len(got) == len(set(left) | set(right)) - len(parts(want))
