"""Each registered query and the pipeline over odd tables, against plain computations that share no code with them."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from pixelloom.llm import common, media, quality_rules, queries
from pixelloom.llm.common import new_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, Text2 int"
WORDS = "the of and river stone winter light bread paper window morning garden letter silver music forest".split()


def table() -> list[tuple]:
    draw = random.Random(12)
    rows = []
    for i in range(400):
        words = [draw.choice(WORDS) + str(draw.randrange(40)) for _ in range(draw.randint(5, 160))]
        if i % 9 == 0:
            words = [w + draw.choice(["#", "%", "|<>", "**"]) * draw.randint(0, 6) for w in words]
        text = " ".join(w + draw.choice(["", "", "\n"]) for w in words)
        if i % 40 == 7:
            text += " mail a.b@c.org or +49 170 1234567, 10.0.0.255 card 4111 1111 1111 1111 <|endoftext|> x"
        if i % 25 == 3 and rows:
            text = rows[draw.randrange(len(rows))][1]
        rows.append((i, text, draw.choice(["aa", "bb", "bb", None]), draw.choice(["s1", "s1", "s1", "s2", None]), len(text), 0))
    rows += [(400, None, None, None, None, None), (401, "", "aa", "s9", 0, 0), (None, "no id " * 30, "aa", "s1", 1, 0), (7, rows[7][1], "bb", "s1", 1, 0), rows[3], (402, "İ ñ x" * 30_000, "bb", "s2", 1, 0), (403, " \n\t ", "aa", "s1", 4, 0)]
    return rows


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    made = tmp_path_factory.mktemp("odd")
    spark.createDataFrame(table(), SCHEMA).repartition(4).write.parquet(f"file://{made}/documents.parquet")
    labels = [(i, int(i % 9 != 0), 0) for i in range(400)] + [(None, 1, 0), (5, None, 0), (8, 0, 0), (8, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{made}/labels.parquet")
    return f"file://{made}"


@pytest.fixture(scope="module")
def none(spark, tmp_path_factory):
    made = tmp_path_factory.mktemp("none")
    spark.createDataFrame([], SCHEMA).write.parquet(f"file://{made}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"file://{made}/labels.parquet")
    return f"file://{made}"


def by_id(r):
    return (r[0] is not None, r[0] if r[0] is not None else 0)


def crc(i):
    return zlib.crc32(b"" if i is None else str(i).encode())


def library_ids(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(str(public_tokenizers.path(name)))
    return lambda t: [*plain.encode(t or "", add_special_tokens=False).ids, 1]


def ids_crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_op1(spark, sf):
    got = queries.op1_language_id(spark, sf).collect()
    assert sorted(by_id(r) for r in got) == sorted(by_id(r) for r in table())
    text = {r[0]: r[1] for r in table()}
    for r in got:
        assert r["held_out"] == (crc(r["doc_id"]) % 3 == 1) and 0 <= r["score"] <= 1
        letters = any(c.isalpha() for c in text[r["doc_id"]] or "")
        assert (r["lang_pred"] in ("aa", "bb")) if letters else (r["lang_pred"] == "und")


def test_op2(spark, sf):
    of, start = library_ids("word_bpe_49k.json"), 0
    got = sorted(queries.op2_token_codes(spark, sf).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [x[0] for x in sorted(table(), key=by_id)]
    left = sorted(((d, ids_crc(ids), len(ids)) for d, t, *_ in table() for ids in [of(t)]), key=str)
    assert sorted(((r["doc_id"], r["ids_crc32"], r["n_tokens"]) for r in got), key=str) == left
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]


def test_op3(spark, sf):
    of = library_ids("byte_bpe_50k.json")
    got, ids = queries.op3_packing(spark, sf).collect(), {}
    for d, t, *_ in table():
        ids.setdefault(d, []).append(of(t))
    places, pieces = {}, {}
    for r in got:
        assert any(len(x) == r["doc_tokens"] and ids_crc(x[r["start"] : r["start"] + r["length"]]) == r["ids_crc32"] for x in ids[r["doc_id"]])
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces[r["doc_id"]] = pieces.get(r["doc_id"], 0) + r["length"]
    assert pieces == {d: sum(map(len, x)) for d, x in ids.items()}
    for own in places.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 2048
    assert sum(pieces.values()) / (2048 * len(places)) > 0.9


def plain_base(t):
    """The base rules, with checks of their own."""

    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0

    rules = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for order, (k, rule) in enumerate(rules.items()):
        for m in re.finditer(rule, t):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": k == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[k]:
                out.append((m.start(), order, m.end(), k))
    return sorted(out)


def test_op4(spark, sf):
    want = {}
    for d, t, *_ in table():
        found = plain_base(t or "")
        want.setdefault(d, set()).add((*[sum(f[3] == k for f in found) for k in ("email", "ip", "card", "phone")], hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in found).encode()).hexdigest()))
    got = queries.op4_pii(spark, sf).collect()
    assert len(got) == len(table()) and any(r["n_card"] and r["n_phone"] and r["n_ip"] and r["n_email"] for r in got)
    assert all((r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) in want[r["doc_id"]] for r in got)


def test_op5(spark, sf):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    own = {}
    for _, t, _, s, *_ in table():
        own[s] = own.get(s, 0) + size(t)
    names = sorted((s for s in own if s is not None)) + [None]
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}
    target, free = {s: 0.0 for s in names}, set(names)
    while free:  # the excess is shared again among those below their limit
        left = sum(own.values()) - sum(target[s] for s in names if s not in free)
        new = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if new[s] > 3 * own[s]}
        target |= {s: 3.0 * own[s] if s in over else v for s, v in new.items() if s in over or not over}
        free = free - over if over else set()
    source = {}
    for d, t, _, s, *_ in table():
        source.setdefault((d, size(t)), set()).add(s)
    got = queries.op5_mixing(spark, sf).collect()
    assert len(got) == len(table())
    taken = {}
    for r in got:
        fits = [s for s in source[r["doc_id"], r["size"]] if own[s] == r["source_size"] and abs(target[s] - r["target"]) < 1e-6 * max(1, target[s])]
        assert fits and 0 <= r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        taken[fits[0]] = taken.get(fits[0], 0) + r["taken"]
    most = 2 * max(size(t) for _, t, *_ in table() if len(t or "") < 10_000)  # a row is there twice
    assert all(abs(taken[s] - target[s]) <= most for s in names if s != "s2")
    assert sorted(map(tuple, queries.op5_mixing(spark, sf).collect()), key=str) == sorted(map(tuple, got), key=str)


def test_op6(spark, sf):
    fps = []
    for _, t, *_ in table():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 3]).encode(), 42) for k in range(max(1, len(words) - 2))] if words else []
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    group = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2 and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    least = {}
    for (d, *_), g in zip(table(), group, strict=True):
        if d is not None:
            least[g] = min(d, least.get(g, d))
    want = sorted((str(d), f"{f:016x}", str(least.get(g))) for (d, *_), f, g in zip(table(), fps, group, strict=True))
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in queries.op6_simhash(spark, sf).collect()) == want


def test_op7(spark, sf):
    want = {}
    for d, t, *_ in table():
        raw = (t or "").encode()
        padded = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        want.setdefault(d, set()).add((len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:])))
    got, same = queries.op7_media(spark, sf).collect(), {}
    assert len(got) == len(table())
    for r in got:
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) in want[r["doc_id"]]
        same.setdefault(r["payload_sha256"], set()).add((r["media_bytes"], r["media_sha256"], r["feature"]))
    assert all(len(v) == 1 for v in same.values())
    # What is said about the stored form is what the files have.
    media.store(spark.read.parquet(f"{sf}/documents.parquet"), path := new_path(spark, "media"))
    stored = {(r["payload_sha256"], len(r["form"]), hashlib.sha256(r["form"]).hexdigest()) for r in spark.read.parquet(f"{path}/media").collect()}
    assert stored == {(k, *next(iter(v))[:2]) for k, v in same.items()}


def test_op8(spark, sf):
    got = queries.op8_quality(spark, sf).collect()
    assert sorted(by_id(r) for r in got) == sorted(by_id(r) for r in table())
    for r in got:
        assert r["held_out"] == (crc(r["doc_id"]) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 400 and r["doc_id"] % 25 != 3]
    assert sum(r["predicted"] == (r["doc_id"] % 9 != 0) for r in held) / len(held) > 0.8


def plain_estimate(x, floors, consistency):
    """The least determinant over four starts, by sorting distances; mean and covariance of the nearest three quarters."""
    m = np.median(x, axis=0)
    scale = np.maximum(1.4826 * np.median(np.abs(x - m), axis=0), floors)
    z = (x - m) / scale
    unit = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-6)
    best = None
    for mean, cov in ((m, np.eye(5)), (m, np.cov(np.tanh(z).T, bias=True)), (m, unit.T @ unit / len(x) * 5), (x.mean(axis=0), np.cov(z.T, bias=True))):
        inverse = np.linalg.inv(np.diag(scale) @ np.atleast_2d(cov) @ np.diag(scale) + np.diag(floors**2))
        for _ in range(30):
            d = np.einsum("ij,jk,ik->i", x - mean, inverse, x - mean)
            near = x[np.argsort(d, kind="stable")[: -(-3 * len(x) // 4)]]
            mean, cov = near.mean(axis=0), np.cov(near.T, bias=True)
            full = cov * consistency + np.diag(floors**2)
            inverse = np.linalg.inv(full)
        if best is None or np.linalg.slogdet(full)[1] < best[0]:
            best = (np.linalg.slogdet(full)[1], mean, cov)
    return best[1:]


def test_op9(spark, sf):
    stats, rows = {}, []
    for d, t, lang, source, *_ in table():
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        three = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        again = {w for w, n in Counter(three).items() if n > 1}
        covered = {k + j for k, w in enumerate(three) if w in again for j in range(3)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        chars, symbols = sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or "")
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        stats.setdefault(d, []).append((len(words), chars, symbols, len(lines) - len(set(lines)), len(covered), failed))
        if not failed:
            n = len(words)
            x = [np.log1p(100 * symbols / chars), np.log1p(chars / n), np.sqrt(len(covered) / n), np.sqrt((len(lines) - len(set(lines))) / max(1, len(lines))), np.sqrt(sum(w.encode().isupper() for w in words) / n)]
            rows.append((d, lang, source, x))
    floors = np.array([0.25, 0.12, 0.08, 0.12, 0.1])
    xs, far = np.array([r[3] for r in rows]), {}
    for d, lang, source, x in rows:
        mean = cov = None
        for own in (np.ones(len(rows), bool), np.array([r[1] == lang for r in rows]), np.array([r[1:3] == (lang, source) for r in rows])):
            m, c = plain_estimate(xs[own], floors, quality_rules.CONSISTENCY)
            w = 1.0 if mean is None else own.sum() / (own.sum() + 50)
            cov = c if mean is None else w * c + (1 - w) * cov + w * (1 - w) * np.outer(m - mean, m - mean)
            mean = m if mean is None else w * m + (1 - w) * mean
        inverse = np.linalg.inv(cov * quality_rules.CONSISTENCY + np.diag(floors**2))
        far.setdefault(d, []).append(float((np.array(x) - mean) @ inverse @ (np.array(x) - mean)))
    got = queries.op9_quality_rules(spark, sf).collect()
    assert len(got) == len(table())
    sure = 0
    for r in got:
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) in stats[r["doc_id"]]
        if r["base_failed"]:
            assert not r["kept"]
        elif len(far[r["doc_id"]]) == 1 and not 45 < (d := far[r["doc_id"]][0]) < 80:
            assert r["kept"] == (d <= 60), (r["doc_id"], d)
            sure += 1
    assert sure > 200


def test_each_statistic_alone_can_reject(spark):
    draw = random.Random(2)
    plain = lambda: [draw.choice(WORDS) + str(draw.randrange(900)) for _ in range(200)]
    texts = ["\n".join(" ".join(w[k : k + 10]) for k in range(0, 200, 10)) for w in (plain() for _ in range(150))]
    repeated = "\n".join(["yes no"] * 45 + [" ".join(plain()[:110])])  # lines again and again
    many = plain()
    many[100:] = (["red", "blue", "green", "grey"] * 25)[:98] + ["end", "end2"]
    odd = [repeated, " ".join(many), " ".join(w + "####" for w in plain()), " ".join(w * 12 for w in plain())]
    docs = spark.createDataFrame([(k, t, "aa", "s", 0, 0) for k, t in enumerate(texts + odd)], SCHEMA)
    got = {r["doc_id"]: r for r in quality_rules.judge(docs).collect()}
    assert all(got[k]["kept"] for k in range(150))
    assert [got[150 + k]["kept"] for k in range(4)] == [False] * 4


def test_few_groups_numbers_are_not_written(spark, sf, monkeypatch):
    docs, before = queries.documents(spark, sf), len(common._MADE)
    few = {r["row"]: r for r in quality_rules.judge(docs).select(F.xxhash64("doc_id", "lang", "source").alias("row"), "distance", "kept").collect()}
    written = [x.rsplit("/", 1)[1].rsplit("-", 1)[0] for x in common._MADE[before:]]
    assert written == ["quality-statistics"]
    # More groups than stay on the driver are written, with the same results.
    monkeypatch.setattr(quality_rules, "FEW", 0)
    many = {r["row"]: r for r in quality_rules.judge(docs).select(F.xxhash64("doc_id", "lang", "source").alias("row"), "distance", "kept").collect()}
    assert "mcd-finest" in "".join(common._MADE[before:])
    assert few.keys() == many.keys() and len(few) > 400 and sum(r["kept"] for r in few.values()) > 200
    for row, r in few.items():
        assert r["kept"] == many[row]["kept"] and (r["distance"] is None) == (many[row]["distance"] is None)
        assert r["distance"] is None or r["distance"] == pytest.approx(many[row]["distance"], rel=1e-6)


def test_op10(spark, sf):
    got = queries.op10_sharding(spark, sf).collect()
    want = sorted(((str(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in table()))
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
    counts = [sorted(r["slot"] for r in got if r["shard"] == s) for s in range(8)]
    assert all(c == list(range(len(c))) for c in counts) and max(map(len, counts)) - min(map(len, counts)) <= 1
    assert {(r["law"], r["grown_shard"]) for r in got} == {("rows", None)} and sum(map(len, counts)) == len(table())


def test_pipeline_over_the_odd_table(spark, sf):
    got = corpus_pipeline.run(spark, sf).collect()
    assert got and sum(r["length"] for r in got if r["start"] == 0 and r["doc_id"] == 1) <= 2048
    kept = {r["doc_id"] for r in queries.op9_quality_rules(spark, sf).collect() if r["kept"]}
    assert {r["doc_id"] for r in got} <= kept and 400 not in kept
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sum(n for _, n in p) <= 2048 for p in places.values())


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_empty_tables(spark, none, name):
    assert queries.queries()[name](spark, none).count() == 0


def test_long_texts_of_cues_are_read_once():
    import time

    from pixelloom.llm import pii

    began = time.process_time()
    assert pii.spans("account number x " * 60_000) == []
    assert time.process_time() - began < 5
    assert [s for s in pii.spans("account no: AB12-3456 78 and") if s[2] == "account"] == [(12, 24, "account")]
