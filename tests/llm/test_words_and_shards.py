"""Alignment, sharding and spelling against brute force and planted cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from seqmill.llm import alignment, common, queries, sharding, spelling
from tests.llm.test_operators import documents, prose
from tests.oracle import SMALL

# ---- 11

TEXTS = [
    None, "", " ", "  ", "a", "one two  three\n\nfour\t five ", "naïve café – “quoted” 漢字かな 😀😀 x", "a▁b", "a ▁", "<|endoftext|> <s> </s> <unk> <0x41>", "Don't you'll 's it's",
    "\x1c \x85 \xa0 x\x00y", "same words here same words here", "same words here same words here", "x" * 3000, "👩‍👩‍👧‍👦" * 50, " " * 500 + "z" + "\n" * 500, "\r\n code(x);\r\n\r\n}", "ﬁ ½ Å é é",
]


def plain_alignments(texts):
    """Per text its A and B ids with their ends in bytes, by the libraries alone; None without tokens."""
    import sentencepiece
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    exact.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    out = []
    for text in texts:
        if not text:
            out.append(None)
            continue
        a, b = exact.encode(" " + text, add_special_tokens=False).ids, model.encode(text)
        raw_a = [bytes(letters[c] for c in exact.id_to_token(i)) for i in a]
        raw_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in map(model.id_to_piece, b)]
        whole = (" " + text).encode()
        out.append((a, np.cumsum([*map(len, raw_a)]).tolist(), b, np.cumsum([*map(len, raw_b)]).tolist()) if b"".join(raw_a) == whole == b"".join(raw_b) else None)
    return out


def plain_scores(texts):
    groups = []
    for t in plain_alignments(texts):
        if t is None:
            groups.append([])
            continue
        a, a_end, b, b_end = t
        cuts = sorted({*a_end} & {*b_end})
        split = lambda ids, ends: [[i for i, e in zip(ids, ends, strict=True) if lo < e <= hi] for lo, hi in zip([0, *cuts], cuts, strict=False)]  # noqa: B023, E731
        groups.append([*zip(split(a, a_end), split(b, b_end), strict=True)])
    links = [[(x, y) for a, b in g for x in a for y in b] for g in groups]
    count = Counter(p for found in links for p in {*found})
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    text = [";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g) for g in groups]
    return [
        (sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(found), sum(count[p] == best[p[0]] for p in found), sum(count[p] for p in found), hashlib.sha256(t.encode()).hexdigest() if g else "")
        for g, found, t in zip(groups, links, text, strict=True)
    ]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("hot", [1 << 18, 7, 0])
def test_alignment_against_brute_force(spark, hot):
    rng = random.Random(5)
    texts = TEXTS + [prose(rng, rng.randint(1, 60)) for _ in range(40)] + ["".join(rng.choice(["a", "B", " ", "  ", "\n", "é", "漢", "😀", "'", "1", "\t", "▁" if rng.random() < 0.05 else "z"]) for _ in range(rng.randint(1, 40))) for _ in range(300)]
    out = alignment.score(alignment.align(documents(spark, texts).repartition(3)), hot)
    assert {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in out.collect()} == dict(enumerate(plain_scores(texts)))


def test_alignment_of_a_table(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    plain = dict(zip([r["doc_id"] for r in rows], plain_scores([r["text"] for r in rows]), strict=True))
    assert {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in queries.op11_token_alignment(spark, SMALL).collect()} == plain


def test_alignment_of_repeated_and_null_ids_and_very_long_texts(spark):
    texts = ["to be or not", "to be or not", "a b " * 300_000, "y" * 400_000, " " * 1_500_000, None]
    docs = documents(spark, texts, ids=[1, 1, None, 2, 3, 4]).withColumn("row", F.lit("clash")).withColumn("pairs", F.lit(1))
    out = alignment.score(alignment.align(docs)).collect()
    assert len(out) == 6 and sorted((r["doc_id"] or 0) for r in out) == [0, 1, 1, 2, 3, 4]
    told = {r["doc_id"]: r for r in out}
    assert told[1]["n_best"] == told[1]["n_links"] and told[1]["count_sum"] >= 2 * told[1]["n_links"]
    assert told[4]["groups_sha256"] == "" and told[None]["n_groups"] == 600_001 and told[3]["n_a"] > 0
    assert alignment.score(alignment.align(documents(spark, []))).count() == 0


def test_groups_give_the_text_back(spark):
    texts = [t for t in TEXTS if t]
    for r, plain in zip(sorted(alignment.groups_of(documents(spark, texts)).collect()), plain_alignments(texts), strict=True):
        a, b = ([i for g in r["groups"] for i in g[side]] for side in ("a", "b"))
        assert (a, b) == ((plain[0], plain[2]) if plain else ([], []))
        if plain:
            assert [g["start"] for g in r["groups"]] == [0, *sorted({*plain[1]} & {*plain[3]})[:-1]]


@pytest.mark.parametrize("seed", range(4))
def test_coalesced_intervals_against_common_ends(seed):
    rng = np.random.default_rng(seed)
    total = 400
    ends = [np.append(np.sort(rng.choice(np.arange(1, total), rng.integers(1, 90), replace=False)), total) for _ in range(2)]
    t = alignment.coalesce(np.arange(len(ends[0])), np.diff(ends[0], prepend=0), np.arange(len(ends[1])), np.diff(ends[1], prepend=0))
    cuts = np.array(sorted({*ends[0].tolist()} & {*ends[1].tolist()}))
    for side, group in ((ends[0], t.a_group), (ends[1], t.b_group)):
        assert (group == np.searchsorted(cuts, side)).all()
    assert t.opens.tolist() == [0, *cuts[:-1].tolist()]
    g, a, b = alignment.linked(t)
    assert sorted(zip(g.tolist(), a.tolist(), b.tolist(), strict=True)) == sorted((i, x, y) for i in range(len(cuts)) for x in np.flatnonzero(t.a_group == i).tolist() for y in np.flatnonzero(t.b_group == i).tolist())


# ---- 12


def drawn(key, layout):
    """The shard of a key by a plain walk down the tree."""
    import xxhash

    def draw(name, weight):
        h = xxhash.xxh64_intdigest(name.encode(), xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), 42))
        return -math.log(((h >> 12) + 1) / ((1 << 52) + 1)) / weight

    at, held = "", list(layout)
    for part in ("region", "rack", "shard"):
        weights = defaultdict(float)
        for s in held:
            weights[f"{at}/{getattr(s, part)}".removeprefix("/")] += s.weight
        at = min(weights, key=lambda name: (draw(name, weights[name]), name))
        held = [s for s in held if f"{s.region}/{s.rack}/{s.shard}".startswith(at + "/") or f"{s.region}/{s.rack}/{s.shard}" == at]
    return held[0].shard


def placed(spark, layout, n=4000):
    rows = sharding.place(spark.range(n).select(F.col("id").alias("doc_id")), layout).select("doc.doc_id", "shard").collect()
    return {r["doc_id"]: r["shard"] for r in rows}


def test_shards_against_a_plain_walk(spark):
    layout = (*sharding.layout_for(8), sharding.Shard("region1", "rack1.0", 11, 2.5), sharding.Shard("c", "x", 12, 0.25))
    assert placed(spark, layout) == {k: drawn(k, layout) for k in range(4000)}


def test_shards_follow_their_weights(spark):
    layout = tuple(sharding.Shard(f"r{s % 2}", f"k{s % 4}", s, w) for s, w in enumerate([1, 2, 3, 4, 1, 1, 2, 6]))
    found = Counter(placed(spark, layout, 40_000).values())
    for s in layout:
        share = s.weight / 20
        assert abs(found[s.shard] / 40_000 - share) < 5 * math.sqrt(share / 40_000)


def test_one_more_shard_takes_rows_only_into_itself(spark):
    layout = sharding.layout_for(8)
    for _ in range(3):
        before, more = placed(spark, layout), sharding.grown(layout)
        after, new = placed(spark, more), more[-1].shard
        assert all(after[k] in (s, new) for k, s in before.items()) and abs(sum(s == new for s in after.values()) / 4000 - 1 / len(more)) < 0.03
        layout = more


def test_movement_stays_in_subtrees_whose_weights_change(spark):
    layout = sharding.layout_for(8)
    where = {s.shard: s for s in layout}
    heavier = tuple(sharding.Shard(s.region, s.rack, s.shard, 3.0) if s.shard == 5 else s for s in layout)
    before, after = placed(spark, layout), placed(spark, heavier)
    moved = {k for k in before if before[k] != after[k]}
    assert moved
    for k in moved:
        old, new = where[before[k]], where[after[k]]
        assert new.region == where[5].region
        if old.region == new.region:
            assert new.rack == where[5].rack
            assert old.rack != new.rack or new.shard == 5


def test_written_shards(spark, tmp_path, monkeypatch):
    texts = [f"text {i % 7} é" for i in range(300)] + [None, "", "x" * 200_000] + ["one of many"] * 400
    ids = [*range(300), None, None, 5] + [77] * 400
    docs = documents(spark, texts, ids).withColumn("shard", F.lit("clash")).withColumn("placed", F.lit(1)).repartition(5)
    layout = sharding.layout_for(8)
    for limit in (common.BROADCAST_ROWS, 0):
        monkeypatch.setattr(sharding, "keyed_join", lambda *a, n=limit, **k: common.keyed_join(*a, limit=n, **k))
        folder = sharding.write_shards(docs, layout, sharding.grown(layout), f"{tmp_path}/{limit}")
        rows = sharding.read_shards(docs, folder).collect()
        assert Counter((r["doc"]["doc_id"], r["doc"]["text"], r["doc"]["shard"]) for r in rows) == Counter((i, t, "clash") for i, t in zip(ids, texts, strict=True))
        slots = defaultdict(list)
        for r in rows:
            slots[r["shard"]].append(r["slot"])
            assert r["grown_shard"] in (r["shard"], 8)
        assert set(slots) <= set(range(8)) and all(sorted(s) == [*range(len(s))] for s in slots.values())
        assert len({r["shard"] for r in rows if r["doc"]["doc_id"] == 77}) == 1
        hot = next(r["shard"] for r in rows if r["doc"]["doc_id"] == 77)
        assert spark.read.parquet(f"{folder}/_shard={hot}").filter("doc.doc_id = 77").select("part").distinct().count() > 1
    assert sharding.read_shards(docs, sharding.write_shards(docs.limit(0), layout)).count() == 0
    with pytest.raises(ValueError):
        sharding.shard_of(F.col("doc_id"), (sharding.Shard("a", "b", 1, 0.0),))


def test_digests_of_a_table(spark):
    told = {r["doc_id"]: r for r in queries.op12_hash_tree(spark, SMALL).collect()}
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    layout = sharding.layout_for(8)
    assert len(told) == len(rows)
    for r in rows:
        raw = (r["text"] or "").encode()
        t = told[r["doc_id"]]
        assert (t["size"], t["text_crc32"], t["law"], t["shard"], t["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "key", drawn(r["doc_id"], layout), drawn(r["doc_id"], sharding.grown(layout)))
    slots = defaultdict(list)
    for t in told.values():
        slots[t["shard"]].append(t["slot"])
    assert set(slots) == set(range(8)) and all(sorted(s) == [*range(len(s))] for s in slots.values())


# ---- 13


def edits(word, known, letters):
    out = {word[:i] + word[i + 1 :] for i in range(len(word))} | {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters} | {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in letters}
    return (out & known) - {word}


def plain_variants(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    letters, known = {c for w in n for c in w}, set(n)
    near = {w: edits(w, known, letters) for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        if best is not None and n[best] >= 10 * n[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (c, len(near[w]), form.get(w), n[form[w]] if w in form else None, root(w)) for w, c in n.items()}


def as_told(df):
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in df.collect()}


@pytest.mark.parametrize("limit", [common.BROADCAST_ROWS, 0])
def test_variants_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(spelling, "keyed_join", lambda *a, **k: common.keyed_join(*a, limit=limit, **k))
    rng = random.Random(11)
    words = ["aabbccdd", "letters", "lettersx", "Größere", "ÀÉîõüßÿ×", "mississippi", "aaaaaaa", "abababab"]
    rows = []
    for i in range(600):
        picked = []
        for _ in range(rng.randint(0, 30)):
            w = rng.choice(words)
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                at, c = rng.randrange(len(w)), rng.choice("abstßé")
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + c + w[at:], w[:at] + c + w[at + 1 :]])
            picked.append(w if rng.random() < 0.9 else w.upper())
        rows.append((rng.choice([None, i, i, 3]), rng.choice([" ", ", ", "\n", "7"]).join(picked)))
    # a chain of forms
    rows += [(10_000 + i, "chained1 ".replace("1", "ones") * 1 + "chainedone " * (i < 220) + "chainedon " * (i < 20) + "chaindon " * (i < 2)) for i in range(3000)]
    rows += [(None, None), (1, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("clash")).repartition(3)
    plain = plain_variants(rows)
    assert as_told(spelling.variants(docs)) == plain
    assert any(form and plain[form][2] for _, _, form, _, _ in plain.values())


def test_variants_of_a_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert as_told(queries.op13_spelling(spark, SMALL)) == plain_variants(rows)


def test_variants_of_odd_tables(spark):
    assert spelling.variants(documents(spark, [])).count() == 0 and spelling.variants(documents(spark, [None, "", "12 ..", "short"])).count() == 0
    long = "ab" * 100_000
    docs = documents(spark, [long + " " + long, long[:-1] + "a " + long[:-1] + "a", "repeated rows " * 5, "repeated rows " * 5], ids=[1, 2, 3, 3])
    assert as_told(spelling.variants(docs, dropped=1 << 40)) == {long: (2, 1, None, None, long), long[:-1] + "a": (2, 1, None, None, long[:-1] + "a"), "repeated": (10, 0, None, None, "repeated")}


@pytest.mark.parametrize("spelled", [0, 8, 9, 10, 48])
def test_rolled_hashes_find_the_same_neighbours(spark, monkeypatch, spelled):
    monkeypatch.setattr(spelling, "SPELLED", spelled)
    rng = random.Random(spelled)
    known = {"".join(rng.choice("abé") for _ in range(rng.randint(7, 12))) for _ in range(400)}
    words = spelling.numbered(spark.createDataFrame([(w, rng.randint(2, 9)) for w in known], "word string, n long"))
    count = {r["id"]: (r["word"], r["n"]) for r in words.collect()}
    assert [w for _, (w, _) in sorted(count.items())] == sorted(known)
    n = dict(count.values())
    near = {w: edits(w, known, "abé") for w in known}
    told = {count[r["id"]][0]: (r["n_near"], count[r["best"]["id"]][0]) for r in spelling.neighbours(words).collect()}
    assert told == {w: (len(v), min(v, key=lambda x: (-n[x], x))) for w, v in near.items() if v}


def test_one_prefix_has_few_rows(spark):
    words = spelling.numbered(spark.createDataFrame([("wordlike" + c, 5) for c in "abcdefghijklmnopqrstuvwxyz"] + [("wordlike", 1000)], "word string, n long"))
    rows = spelling.rotations(words)
    assert rows.count() == 26 * (9 + 10) + 8 + 9
    assert rows.groupBy("prefix").count().agg(F.max("count")).first()[0] == 27
    assert {r["n_near"] for r in spelling.neighbours(words).collect()} == {26}
