"""Each corpus operator against brute force, round trips and planted cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqmill.llm import chat, components, context_mixing, fingerprint, host_rules, mixing, near_dedup, oracle, packing, pii, queries, symbols, warc, weak_labels
from seqmill.llm.common import keyed_join, stash
from tests.oracle import SMALL, both

DOC = "doc_id long, text string, lang string, source string, n_chars long, n_words string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, texts, ids=None, sources=None):
    rows = [(i if ids is None else ids[i], t, "en", sources[i] if sources else "s", len(t or ""), "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


def prose(rng, n):
    return " ".join("".join(rng.choice(["an", "the", "or", "ti", "sh", "ing", "é"]) for _ in range(rng.randint(1, 3))) for _ in range(n))


ODD = [None, "", " \n\t ", "one", "a b c d e a b c d e\nx\n\nx\n", "Ünï cödé \x1c words " * 4, "word " * 3000, "same text here for all of us to see twice", "same text here for all of us to see twice"]
SQL = {k: v for k, v in oracle.SQL.items()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    ours, theirs = both(spark, queries.queries()[name], SQL[name])
    assert ours == theirs and ours


def test_empty_tables(spark):
    docs = documents(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = context_mixing.fit(docs)
    for out in (
        fingerprint.compare_with_next(docs), packing.pack(docs), mixing.mix_documents(docs), pii.detect(docs), host_rules.judge(docs), host_rules.keep_good(docs), near_dedup.find_components(docs), near_dedup.keep_firsts(docs), pii.mask_documents(docs),
        context_mixing.score(docs, *model), weak_labels.score(docs, weak_labels.fit(docs, labels)),
        chat.read_back(chat.expand(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))),
        warc.read_warc(warc.write_warc(warc.plan_revisits(spark.createDataFrame([], "page_id long, url string, html string")))),
    ):
        assert out.count() == 0


# ---- 1


def test_fingerprints_against_brute_force(spark):
    rng = random.Random(1)
    texts = [*ODD, *(prose(rng, rng.randint(1, 80)) for _ in range(40))]
    ids = rng.sample(range(1000), len(texts))
    got = {r.doc_id: r for r in fingerprint.compare_with_next(documents(spark, texts, ids).repartition(5)).collect()}
    order = sorted(zip(ids, texts, strict=True))
    assert len(got) == len(texts)
    for (i, t), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        t, following = t or "", following or ""
        e = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        a, b, c = (fingerprint.digest_bytes(x.encode()) for x in (t, e, following))
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint) == (len(t), hashlib.sha256(e.encode()).hexdigest(), a.tobytes().hex())
        assert (r.edited_fingerprint, r.near_edited, r.near_next) == (b.tobytes().hex(), fingerprint.likeness(a, b), fingerprint.likeness(a, c))


def plain_digest(data: bytes) -> str:
    """The quartile bucket digest, written apart from the library: dictionaries and loops alone."""
    counts = [0] * 256
    for at in range(len(data)):
        for shape, (j, k) in enumerate([(1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4)]):
            if at + k < len(data):
                v = data[at] + 256 * data[at + j] + 65536 * data[at + k] + shape * 16777216
                counts[v * 2654435761 % 2**32 // 2**24] += 1
    q1, q2, q3 = (sorted(counts)[i] for i in (63, 127, 191))
    size = 0 if not data else round(math.log(len(data)) / math.log(1.1)) % 256
    ratios = 0 if not q3 else (q1 * 100 // q3 % 16) * 16 + q2 * 100 // q3 % 16
    quartile = [(c > q1) + (c > q2) + (c > q3) for c in counts]
    body = [sum(quartile[4 * i + j] * 4**j for j in range(4)) for i in range(64)]
    return bytes([hashlib.blake2b(data, digest_size=1).digest()[0], size, ratios, *body]).hex()


def test_digests_against_a_plain_loop():
    rng = random.Random(21)
    for x in [*(t or "" for t in ODD), "ab", "abc", *(prose(rng, rng.randint(1, 300)) for _ in range(30))]:
        assert fingerprint.digest_bytes(x.encode()).tobytes().hex() == plain_digest(x.encode())


def test_fingerprints_of_null_and_repeated_ids(spark):
    """Rows in ascending (doc_id, text), null first; ids on a part's edge and ids that are all alike too."""
    rng = random.Random(22)
    ids = [None, None, *[7] * 30, *(rng.randrange(40) for _ in range(60))]
    texts = [prose(rng, rng.randint(0, 9)) for _ in ids]
    got = fingerprint.compare_with_next(documents(spark, texts, ids).repartition(4)).collect()
    rows = sorted(zip(ids, texts, strict=True), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    want = [(i, hashlib.sha256((t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode()).hexdigest(), plain_digest(t.encode())) for (i, t), (_, n) in zip(rows, rows[1:] + rows[:1], strict=True)]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.edited_sha256, r.fingerprint)) for r in got)
    same = fingerprint.compare_with_next(documents(spark, texts[:9], [3] * 9)).collect()
    assert len(same) == 9 and {r.doc_id for r in same} == {3}


def test_one_document_is_followed_by_itself(spark):
    r = fingerprint.compare_with_next(documents(spark, ["abcdefgh"])).first()
    assert r.near_next == 1.0 and r.edited_sha256 == hashlib.sha256(b"abcdabcd").hexdigest()


def test_pieces_do_not_change_counts():
    data = random.Random(0).randbytes(3 * fingerprint._PIECE // 2)
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    n = len(b) - 2
    v = b[:n] | b[1 : n + 1] << np.uint32(8) | b[2:] << np.uint32(16)
    assert fingerprint.bucket_counts(data).sum() == sum(len(b) - k for _, _, k in fingerprint.SHAPES)
    first = np.bincount((v * np.uint32(0x9E3779B1)) >> np.uint32(24), minlength=256)
    assert (fingerprint.bucket_counts(data) >= first).all()


def test_likeness_is_bounded_and_symmetric():
    rng = random.Random(2)
    prints = [fingerprint.digest_bytes(prose(rng, 60).encode()) for _ in range(20)]
    for a in prints:
        assert fingerprint.likeness(a, a) == 1.0
        for b in prints:
            assert 0 <= fingerprint.likeness(a, b) == fingerprint.likeness(b, a) <= 1


# ---- 2


def test_ids_equal_those_of_the_tokenizer_file():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    rng = random.Random(3)
    for x in [*filter(None, ODD), "<|endoftext|> it's 1234　\U0001f600  x", *(prose(rng, 50) for _ in range(30))]:
        assert packing.token_ids(x, packing.default_ranks()).tolist() == [*t.encode(x, add_special_tokens=False).ids, 0]


def test_packed_ids_are_those_of_the_file_with_its_own_settings(spark):
    """Special strings in a text get the ids that the unchanged tokenizer gives them."""
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n y", "<|endoftext|", " <|endoftext|>  z", "plain"]
    got = {r.doc_id: r for r in packing.pack(documents(spark, texts)).collect()}
    for i, x in enumerate(texts):
        ids = np.array([*t.encode(x, add_special_tokens=False).ids, 0], "<u4")
        assert (got[i].doc_tokens, got[i].ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))
    plain = {r.doc_id: r for r in packing.pack(documents(spark, texts), special=False).collect()}
    assert plain[5].ids_crc32 == got[5].ids_crc32 and plain[0].doc_tokens > got[0].doc_tokens


@pytest.mark.parametrize("seed", range(3))
def test_ids_of_long_runs_of_blanks(seed, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng, path = random.Random(seed), packing.default_ranks()
    for text in (" " * 2_000_000, "\n" * 2_000_000 + "x", "a" + " \n" * 1_000_000 + "<|endoftext|>" + "\t" * 20_000 + " b")[seed : seed + 1]:
        assert packing.token_ids(text, path, special=True)[:-1].tolist() == exact.encode(text, add_special_tokens=False).ids
    monkeypatch.setattr(packing, "_LONG_BLANKS", re.compile(packing._LONG_BLANKS.pattern.replace("10000", "3")))
    for _ in range(2000):
        text = "".join(rng.choice(["a", "b c", " ", "  ", "\n", "\t\r", "\x85", "\xa0", "\u2003", "\u3000", "\x1c", "!", "7", "'s", "é", "<|endoftext|>"]) for _ in range(rng.randint(0, 30)))
        assert packing.token_ids(text, path, special=True)[:-1].tolist() == exact.encode(text, add_special_tokens=False).ids


def test_documents_of_blanks_are_packed(spark):
    rows = packing.pack(documents(spark, [" " * 2_000_000, "\n" * 2_000_000, "a b"])).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).collect()
    assert {(r["doc_id"], r["n"], r["all"]) for r in rows} == {(0, 2_000_001, 2_000_001), (1, 1_000_001, 1_000_001), (2, 3, 3)}


def test_little_padding(spark):
    """Of all places in the sequences under one in a hundred is padding."""
    rows = packing.pack(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").coalesce(2))
    used = rows.agg(F.sum("length").alias("n"), F.countDistinct("sequence_id").alias("s")).first()
    assert used.n > 0.99 * packing.CAPACITY * used.s


def test_packing_holds_every_id_once(spark):
    rng = random.Random(4)
    texts = [*ODD, *(prose(rng, rng.randint(1, 900)) for _ in range(60))]
    rows = packing.pack(documents(spark, texts).repartition(3)).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, t in enumerate(texts):
        ids, at = packing.token_ids(t or "", packing.default_ranks()), 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY


@pytest.mark.parametrize("seed", range(5))
def test_tightest_window_against_a_plain_search(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 65, 300)
    windows, offsets, n = packing.best_fit_decreasing(sizes, 64)
    room: list[int] = []
    for i in np.argsort(-sizes, kind="stable"):
        fits = [r for r in room if r >= sizes[i]]
        if fits:
            room[room.index(min(fits))] -= sizes[i]
        else:
            room.append(64 - sizes[i])
    used = np.bincount(windows, weights=sizes, minlength=n)
    assert n == len(room) and sorted(64 - used) == sorted(room)


# ---- 3


def test_mixture_meets_its_weights(spark):
    rng = random.Random(5)
    sources = ["big"] * 600 + ["mid"] * 150 + [None] * 60
    docs = documents(spark, [prose(rng, rng.randint(1, 40)) if i % 50 else None for i in range(810)], sources=sources)
    mix = mixing.Mix(repetition_limit=1.5)
    plan = {r.source: r for r in mixing.plan_sources(mixing.slim_table(docs, mix), mix).collect()}
    tokens = Counter()
    for r in docs.collect():
        tokens[r.source if r.source is not None else "\0"] += len(WORD.findall(r.text or ""))
    total = sum(tokens.values())
    t = next(math.log(plan["big"].weight / plan["mid"].weight) / math.log(tokens["big"] / tokens["mid"]) for _ in (0,))
    assert (tokens["big"] / tokens["\0"]) ** (1 - t) == pytest.approx(1.5, rel=1e-4)
    z = sum((n / total) ** t for n in tokens.values())
    out = mixing.mix_documents(docs, mix)
    assert out.columns == [*docs.columns, "__mix"]
    rows = out.collect()
    got, times = Counter(), Counter()
    for r in rows:
        got[r.source if r.source is not None else "\0"] += len(WORD.findall(r.text or ""))
        times[r.doc_id] += 1
    assert len(times) == 810 and max(times.values()) == 2  # none is dropped
    for s, n in tokens.items():
        assert plan[s].weight == pytest.approx((n / total) ** t / z)
        assert plan[s].epochs * n - 41 <= got[s] <= plan[s].epochs * n + 1
    # every block holds the sources in proportion
    blocks = Counter(r["__mix"].block // 16 for r in rows)
    assert set(blocks) == {0, 1, 2, 3} and max(blocks.values()) < 1.3 * min(blocks.values())


def test_target_entropy_and_budget(spark):
    docs = documents(spark, ["a b c d"] * 80 + ["a b"] * 10, sources=["x"] * 80 + ["y"] * 10)
    mix = mixing.Mix(repetition_limit=None, target_entropy=0.5, budget=200)
    plan = mixing.plan_sources(mixing.slim_table(docs, mix), mix).collect()
    assert -sum(r.weight * math.log(r.weight) for r in plan) == pytest.approx(0.5, abs=1e-3)
    held = mixing.mix_documents(docs, mix).groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()
    want = {r.source: r.weight * 200 for r in plan}
    assert all(want[r.source] - 4 <= r.n <= want[r.source] + 1e-6 for r in held)
    tight = mixing.Mix(repetition_limit=3.0, target_entropy=0.69, budget=200)
    assert max(r.epochs for r in mixing.plan_sources(mixing.slim_table(docs, tight), tight).collect()) <= 3.001


# ---- 4


def test_chat_round_trip(spark):
    odd = ["<|im_end|><|im_start|>assistant ok", "<\\|x<\\\\|", "a<", "|b", "", None, "é\n\n", "<|im_start|>", "tail\\"]
    rows = [(1, i, ("assistant" if i % 2 else "user"), t) for i, t in enumerate(odd)] + [(2, 0, "system", "only"), (2, 0, "system", "only"), (None, 0, None, "x"), (None, None, "odd\nrole%0A<|", "y"), (3, 0, "assistant", "first")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("example", F.lit("clash"))
    examples = chat.expand(table.repartition(3))
    back = {r.conv_id: r for r in chat.read_back(examples).collect()}
    by = defaultdict(list)
    for c, turn, role, text in rows:
        by[c].append((turn is not None, turn or 0, role or "", text or ""))
    for c, turns in by.items():
        turns.sort()
        assert [tuple(t) for t in back[c].turns] == [(r, t) for *_, r, t in turns]
        assert back[c].trained == "".join(t for *_, r, t in turns if r == "assistant")
    made = examples.collect()
    assert sum(r.loss_length > 0 or not r.ends for r in made if r.conv_id == 1) == 4
    for r in made:  # only the last reply is trainable, and nothing but the template's marks holds control strings
        assert r.loss_length == 0 or r.formatted[r.loss_start + r.loss_length :] == "<|im_end|>\n"
        assert "<|" not in r.formatted.replace("<|im_start|>", "").replace("<|im_end|>", "")


# ---- 5

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for k, kind in enumerate(BASE):
        for m in re.finditer(BASE[kind], text):
            digits = re.sub("[^0-9]", "", m[0])
            total = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 14 <= len(digits) <= 19 and total % 10 == 0, "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [s for *_, s in sorted(out)]


@pytest.mark.parametrize("seed", range(4))
def test_base_spans_against_the_patterns(seed):
    rng = random.Random(seed)
    parts = ["a@b.c", "@", ".", "-", " ", "4539578763621486", "4539 5787 6362 1486", "1.2.3.4", "256.1.1.1", "007.0.0.1", "+1 (375) 555-4393", "+", "x", "é", "(", "12", "user.name+x@mail-1.example.co", "a@b@c.d", "\n", "0"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert [f"{s.kind}:{s.start}:{s.end}" for s in pii.find_spans(text) if s.kind in pii.BASE] == plain_spans(text), text


def test_added_kinds_and_masks(spark):
    text = "pay to account GB82 WEST 1234 5698 7654 32 now, not GB82 WEST 1234 5698 7654 33; ssn 123-45-6789, 123-45-6789 " + "." * 50
    kinds = [s.kind for s in pii.find_spans(text)]
    assert kinds.count("iban") == 1 and "national" in kinds
    assert [s.kind for s in pii.find_spans("x" * 60 + " 123-45-6789 " + "x" * 60)] == []
    assert pii.mask("to a@b.c!", pii.find_spans("to a@b.c!")) == "to <EMAIL>!"
    got = pii.mask_documents(documents(spark, [None, "", "mail é a@b.c or +1 (375) 555-4393."])).orderBy("doc_id").collect()
    assert [(r.text, r.n_chars) for r in got] == [(None, None), ("", 0), ("mail é <EMAIL> or <PHONE>.", 26)]


def test_numbers_of_any_length_and_whole_words():
    long = "0" * 5000
    for text in (f"1.2.3.{long}7", f"1.2.3.{long}256", f"{long}.0.0.0", "9" * 5000 + ".1.1.1", f"+1 {long}", f"4539 {long}", f"DE89{long}"):
        got = [f"{s.kind}:{s.start}:{s.end}" for s in pii.find_spans(text) if s.kind in pii.BASE]
        assert got == ([f"ip:0:{len(text)}"] if text.startswith(("1", "0")) and not text.endswith("256") else []), text[:20]
    kinds = lambda text: [s.kind for s in pii.find_spans(text)]
    assert kinds("nationalities 123-45-6789") == kinds("hassn 123-45-6789") == [] and kinds("(SSN) 123-45-6789") == kinds("123-45-6789 national") == ["national"]


def test_ibans_end_before_capitals_and_numbers():
    for text, ends in [
        ("DE89 3704 0044 0532 0130 00 BIC: COBADEFFXXX", [27]), ("DE89370400440532013000 EUR 500", [22]), ("GB82 WEST 1234 5698 7654 32 OR CALL", [27]),
        ("DE89 3704 0044 0532 0130 00 GB82 WEST 1234 5698 7654 32 X", [27, 55]), ("AB12 DE89370400440532013000 A", [27]), ("DE89 3704 0044 0532 0130 01 EUR 500", []), ("NO93 8601 1117 947 KR", [18]),
    ]:
        assert [s.end for s in pii.find_spans(text) if s.kind == "iban"] == ends, text
    assert pii.mask("to DE89370400440532013000 EUR 500", pii.find_spans("to DE89370400440532013000 EUR 500")) == "to <IBAN> EUR 500"


def test_patterns_are_linear():
    import time

    began = time.time()
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 150_000, "+" * 300_000, "+1" + " " * 300_000, "@a" * 150_000, "A1" * 150_000):
        pii.find_spans(text)
    assert time.time() - began < 20


# ---- 6


def test_scores_against_brute_force(spark):
    rng = random.Random(6)
    texts = [*ODD, *(prose(rng, rng.randint(0, 60)) for _ in range(120))]
    ids = [None if i == 20 else i for i in range(len(texts))]
    docs = documents(spark, texts, ids)
    model, words = context_mixing.fit(docs)
    got = {r.doc_id: r for r in context_mixing.score(docs, model, words).collect()}
    assert len(got) == len(texts)
    split = [(x or "").encode().lower().split() for x in texts]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i in ids]
    c, ends = Counter(), 0
    for w, h in zip(split, held, strict=True):
        if not h:
            c.update(w)
            ends += 1
    n, v = sum(c.values()) + ends, len(c) + 1
    for i, w, h in zip(ids, split, held, strict=True):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (h, len(w) + 1, sum(c[x] > 0 for x in w) + 1, n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w) + math.log10((ends + 1) / (n + v + 1)))
        assert r.score < 0


def test_model_is_a_distribution(spark):
    rng = random.Random(7)
    model, _ = context_mixing.fit(documents(spark, [prose(rng, 40) for _ in range(60)]))
    np.testing.assert_allclose((10.0 ** model.symbols.table.astype(float)).sum(1), 1, rtol=1e-3)
    # all one-byte beginnings, with what follows: a closing space or anything else
    s = context_mixing.spell(pa.array([b"a"], pa.binary()))
    total = np.zeros(2)
    for bit in range(8):
        odds, gate, cell, value = model.spelling.decisions(s, bit)
        p = model.spelling.mixer.predict(odds, gate, cell)
        assert ((p > 0) & (p < 1)).all()
        total += np.log10(np.where(value, p, 1 - p))
    assert total.sum() == pytest.approx(model.spelling.log10_probability(pa.array([b"a"], pa.binary()))[0])


def test_held_out_gain(spark):
    """On documents the model has not seen it does better than the counts alone."""
    got = queries.op6_context_mixing(spark, SMALL).filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert got.s > got.b


def test_symbols_are_chosen_by_training_counts(spark):
    """Held-out documents change neither the symbols nor their order, and their own words escape."""
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 7 == 2][:10]
    rest = [i for i in range(300) if zlib.crc32(str(i).encode()) % 7 != 2][:40]
    texts = ["once" + "".join(chr(97 + int(d)) for d in str(i)) + " some words, more words" for i in rest]
    alone, _ = context_mixing.fit(documents(spark, texts, rest))
    model, _ = context_mixing.fit(documents(spark, texts + ["unheard unheard more more more"] * len(held), rest + held))
    assert model.words == alone.words == [b"more", b"some", b"words", b"words,"]


def test_counts_of_escaped_words_and_of_the_teaching_fold_are_used(spark):
    spelled = np.array([-3.0, -5.0])
    np.testing.assert_allclose(10 ** context_mixing.mixed_with_counts(0.25, np.array([0.1, 0.0]), spelled), [0.25 * 0.1 + 0.75e-3, 0.75e-5])
    counts, checks = np.ones((1, 4)), np.zeros((1, 4))
    checks[0, 3] = 400  # only the teaching fold has it that often
    assert (context_mixing.SymbolModel.fit(counts, checks).table[0] > np.log10(0.9)).tolist() == [False, False, False, True]
    rng = random.Random(12)
    rare = ["".join(rng.choice("abcdefghij") for _ in range(12)) for _ in range(400)]
    texts = [f"{rare[i]} and then" for i in range(400)] + [f"{rare[i]} and" for i in range(400)]
    model, words = context_mixing.fit(documents(spark, texts))
    c = {bytes(r.word).decode(): r.c for r in words.collect()}
    new = "jjjjiiiihhhh"
    known = next(w for w in rare if c.get(w) == 1)
    assert known.encode() not in model.words
    got = []
    for share in (0.0, 0.5):
        model.share, model.rare_tokens = share, max(model.rare_tokens, 1)
        docs = documents(spark, [known, new])
        got.append({r.text: r.score for r in context_mixing.score(docs, model, words).join(docs.select("doc_id", "text"), "doc_id").collect()})
    plain = model.spelling.log10_probability(pa.array([known.encode(), new.encode()], pa.binary()))
    for w, p, n in ((known, plain[0], 1), (new, plain[1], 0)):
        assert got[1][w] - got[0][w] == pytest.approx(np.log10(0.5 * n / model.rare_tokens + 0.5 * 10**p) - p, abs=1e-6)


def plain_score(m, text, c, passages, training):
    """log10 P of a text by the model's own numbers, token by token and bit by bit; c, passages: training counts."""
    mask, nodes = 2**64 - 1, m.coder.code

    def mix64(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    def predict(mixer, odds, gate, cell):
        x = min(max(sum(w * o for w, o in zip(mixer.weights[gate], [*odds, 1.0], strict=True)), -12), 12)
        p = 1 / (1 + math.exp(-x))
        zeros, ones = mixer.hits[cell * context_mixing.BINS + min(int((x + 12) * context_mixing.BINS / 24), context_mixing.BINS - 1)]
        return min(max((p + (ones + 8 * p) / (zeros + ones + 8)) / 2, 1e-4), 1 - 1e-4)

    def counts(history):
        n = [0, 1, 2.5, 5.5, 16, 64, 360, 3000][history >> 5]
        ones = n / (1 + math.exp(-((history & 31) / 2 - 8)))
        return n - ones, ones

    place = {w: i + 2 for i, w in enumerate(m.words)}
    words = text.encode().lower().split()
    symbols = [place.get(w, 0) for w in words] + [1]
    tails = [sum(b << 8 * i for i, b in enumerate(reversed(w[-3:]))) for w in words]
    kinds = [s if 2 <= s < 4096 else 4096 + mix64(t) % 4096 for s, t in zip(symbols, tails, strict=False)]
    each, state = [], 0
    for i, symbol in enumerate(symbols):
        one, two, tail = (kinds[i - 1] if i else 0), (kinds[i - 2] if i > 1 else 0), (tails[i - 1] if i else 0)
        keys = [mix64(one + (1 << 50)), mix64((two << 13) + one + (2 << 50)), mix64((tail << 5) + state + (3 << 50))]
        total = 0.0
        for at in range(nodes.starts[symbol], nodes.starts[symbol + 1]):
            node, bit = int(nodes.nodes[at]), int(nodes.bits[at])
            x = float(nodes.odds[state, node])
            p = 1 / (1 + math.exp(-round(3 * x) / 3))  # the prior of counts is in thirds
            odds, sure = [x], []
            for k, key in enumerate(keys):
                h = int(m.table[k][(key ^ node * 0x9E3779B97F4A7C15 & mask) * 0xD6E8FEB86659FD93 % 2**64 >> 64 - m.coder.bits])
                zeros, ones = counts(h)
                odds.append(math.log((ones + p) / (zeros + 1 - p)) - math.log(p / (1 - p)))
                sure.append(h >> 5)
            p = predict(m.mixer, odds, sure[0] * 64 + sure[1] * 8 + sure[2], sure[0] * 8 + sure[1])
            total += math.log10(p if bit else 1 - p)
        if symbol == 0:
            plain = m.spelling.log10_probability(pa.array([words[i]], pa.binary()), np.array([state]))[0]
            total += math.log10(m.share * c.get(words[i], 0) / max(m.rare_tokens, 1) + (1 - m.share) * 10**plain)
        each.append(total)
        state = int(m.coder.classes[symbol]) or state
    hashes = [mix64(sum(mix64(b + (i << 8)) for i, b in enumerate(w)) & mask) for w in words] + [0x5851F42D4C957F2D]
    cut, found = 0, []
    for i, h in enumerate(hashes):
        if mix64(h) % context_mixing.PASSAGE == 0 or i == len(words):
            key = mix64((sum(mix64((x + k * 0x9E3779B97F4A7C15) & mask) for k, x in enumerate(hashes[cut : i + 1])) + i + 1 - cut) & mask)
            found.append((key - 2**64 if key >= 2**63 else key, cut, i + 1))
            cut = i + 1
    long = Counter(k for k, a, b in found if b - a >= context_mixing.LEAST)
    seen, result = Counter(), 0.0
    for key, a, b in found:
        have = max(passages.get(key, 0) - (long[key] if training else 0), 0) + seen[key] if b - a >= context_mixing.LEAST else 0
        result += math.log10(m.known_share * have / (m.n_passages + sum(long.values()))) if have else math.log10(1 - m.known_share) + sum(each[a:b])
        seen[key] += 1
    return result


def test_scores_against_a_plain_loop(spark):
    """Every score of a small corpus with copies, repeated passages, odd and long texts, once with passages of their own and once as new documents."""
    rng = random.Random(13)
    shared = [prose(rng, 40) for _ in range(3)]
    texts = [*ODD, *(prose(rng, rng.randint(0, 50)) + " " + rng.choice(shared) + " " + prose(rng, 9) for _ in range(80)), " ".join([shared[0]] * 5), "é" * 90 + " " + "x" * 200, "A" + shared[1][1:].upper()]
    texts += texts[20:40]
    ids = [None if i == 30 else i for i in range(len(texts))]
    docs = documents(spark, texts, ids).repartition(3)
    m, words = context_mixing.fit(docs)
    c = {bytes(r.word): r.c for r in words.collect()}
    passages = {int.from_bytes(r.passage, "big", signed=True): r.a + r.b for r in context_mixing._passage_table(spark, m.passages).collect()}
    for own in (True, False):
        got = {r.doc_id: r.score for r in context_mixing.score(docs, m, words, own).collect()}
        for i, x in zip(ids, texts, strict=True):
            training = own and (i is None or zlib.crc32(str(i).encode()) % 7 != 2)
            assert got[i] == pytest.approx(plain_score(m, x or "", c, passages, training), rel=1e-4, abs=1e-4), (i, x)


def test_files_and_tasks_change_no_score(spark, monkeypatch):
    """The whole of the smallest table in one part and in four other ones, with lessons small enough to be several."""
    monkeypatch.setattr(context_mixing, "LESSON_DOCS", 12)
    monkeypatch.setattr(context_mixing, "LESSON_WORDS", 300)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    one, four = ({r.doc_id: r.score for r in context_mixing.score(d, *context_mixing.fit(d)).collect()} for d in (docs.coalesce(1), docs.orderBy("n_chars").repartition(4)))
    assert len(one) > 100 and all(one[i] == pytest.approx(four[i], rel=1e-9) for i in one)


def test_held_out_texts_change_no_other_score(spark):
    rng = random.Random(14)
    texts, others = ([prose(rng, rng.randint(5, 60)) for _ in range(120)] for _ in range(2))
    held = {i for i in range(120) if zlib.crc32(str(i).encode()) % 7 == 2}
    mixed_texts = [others[i] if i in held else t for i, t in enumerate(texts)]
    one, two = ({r.doc_id: (r.score, r.base_score) for r in context_mixing.score(d, *context_mixing.fit(d)).collect()} for d in (documents(spark, x).coalesce(1) for x in (texts, mixed_texts)))
    assert all(one[i] == pytest.approx(two[i], rel=1e-9) for i in one if i not in held) and all(one[i] != two[i] for i in held)


def test_the_words_before_matter(spark):
    """A text in the order that training shows is likelier than its words in another order."""
    rng = random.Random(15)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(30)]
    follow = {w: rng.sample(words, 2) for w in words}
    texts = []
    for _ in range(400):
        line = [rng.choice(words)]
        while len(line) < 30:
            line.append(rng.choice(follow[line[-1]]))
        texts.append(" ".join(line))
    texts += [" ".join(rng.sample(t.split(), 30)) for t in texts[:40]]
    docs = documents(spark, texts, [*range(400), *range(400, 440)])
    model = context_mixing.fit(docs.filter("doc_id < 380"))
    got = {r.doc_id: r.score for r in context_mixing.score(docs, *model, own=False).collect()}
    assert np.mean([got[i] for i in range(380, 400)]) > np.mean([got[i] for i in range(400, 440)]) + 15


def test_the_symbols_code_is_a_prefix_code():
    rng = np.random.default_rng(3)
    p = rng.dirichlet(np.full(200, 0.2), 3)
    code = context_mixing.PrefixCode.of(np.log10(np.maximum(p, 1e-12)))
    size = np.diff(code.starts)
    assert (0.5 ** size).sum() == pytest.approx(1) and (size * p[0]).sum() < -(p[0] * np.log2(np.maximum(p[0], 1e-12))).sum() + 1
    for state in range(3):  # the nodes' odds give back the state's probabilities
        x = code.odds[state][code.nodes]
        got = np.add.reduceat(np.log10(1 / (1 + np.exp(np.where(code.bits, -x, x)))), code.starts[:-1])
        held = p[state] > 1e-4
        np.testing.assert_allclose(got[held], np.log10(p[state])[held], atol=2e-3)


def test_contexts_see_only_what_is_before():
    one, two = (context_mixing.spell(pa.array([w], pa.binary())) for w in (b"abcdef", b"abcxyz"))
    assert (one.contexts[:, :4] == two.contexts[:, :4]).all() and (one.contexts[:, 4] != two.contexts[:, 4]).all()
    both_ = context_mixing.spell(pa.array([b"zz", b"abcdef"], pa.binary()))
    assert (both_.contexts[:, 3:] == one.contexts).all()


def test_equal_tokens_are_counted_at_once_and_as_often_as_they_are_there(monkeypatch):
    """Counts of slots, with tokens waiting and without, are those of every decision by itself; a repeated text costs no decisions more."""
    p = np.random.default_rng(4).dirichlet(np.full(40, 0.5))
    words = pa.array([f"w{i}".encode() for i in range(38)], pa.binary())
    coder = symbols.Coder(words, np.arange(40) % 3, context_mixing.PrefixCode.of(np.log10(np.stack([p, p, p]))), 14)
    rng = random.Random(16)
    texts = pa.array([" ".join(f"w{rng.randint(0, 45)}" for _ in range(rng.randint(0, 30))) for _ in range(60)] + [""] + ["w1 w2 w3"] * 90)
    _, _, t = symbols.tokens_of(coder, texts)
    plain = np.zeros((symbols.CONTEXTS, 2 << 14))
    for _, _, decisions in coder.runs(t):
        for k, slots in enumerate(decisions.slots()):
            np.add.at(plain[k], 2 * slots + decisions.bit, 1)
    for wait in (1, 1 << 20):
        monkeypatch.setattr(symbols, "_WAIT", wait)
        seen = symbols.Seen(coder)
        for part in (texts[:20], texts[20:]):
            seen.add(symbols.tokens_of(coder, part)[2])
        seen.count()
        assert (seen.tables == plain).all()
    worked = []
    runs = symbols.PrefixCode.runs
    monkeypatch.setattr(symbols.PrefixCode, "runs", lambda *a: (worked.append(len(r[3])) or r for r in runs(*a)))
    for n in (1, 90):
        seen = symbols.Seen(coder)
        seen.add(symbols.tokens_of(coder, pa.array(["w1 w2 w3"] * n))[2])
        seen.count()
    assert len(worked) == 6 and worked[:3] == worked[3:]


def test_rows_of_words_are_narrow_and_few(spark):
    """A word's row carries nothing of its document, passages that say nothing have no row, and words are summed by text before they leave a task."""
    rng = random.Random(17)
    docs = documents(spark, [prose(rng, 60) for _ in range(80)])
    m, words = context_mixing.fit(docs)
    shared = spark.sparkContext.broadcast(m)
    rows = context_mixing.bounded(docs).select("doc_id", "text", context_mixing.fold(F.col("doc_id")).alias("fold"), F.monotonically_increasing_id().alias("row"))
    first = rows.mapInArrow(context_mixing._first_pass(shared, True), context_mixing._FIRST_DDL).withColumn("c", F.lit(None).cast("long")).cache()
    escaping = first.filter("length(states) > 0").agg(F.sum(F.length("states"))).first()[0] or 0
    resolved = first.mapInArrow(context_mixing._resolve(shared), context_mixing._WORD_DDL).cache()
    assert len(resolved.columns) == 5 and resolved.filter("doc is not null").count() == 80
    assert first.filter("length(states) = 0 and doc is null").count() > 0
    assert resolved.count() == escaping + first.filter("length(states) = 0 and doc is not null").count()
    joined = resolved.coalesce(1).join(F.broadcast(words.filter("c > 0")), "word", "left")
    second = joined.mapInArrow(context_mixing._second_pass(shared), context_mixing._ROW_DDL)
    assert second.filter("n_tokens is null").groupBy("row").count().filter("count > 1").count() == 0


def test_a_word_belongs_to_the_class_that_has_it_most(spark):
    """The last of equal classes, without a sort of all words."""
    rng = random.Random(18)
    texts = [f"{prose(rng, 8)} shared{'x' * (i % 4)}" for i in range(90)]
    docs = spark.createDataFrame([(i, t, ("de", "en", "fr")[i % 3]) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    m, words = context_mixing.fit(docs)
    by_class = spark.read.parquet(m.passages).filter(F.col("cls") >= 0)
    expected = by_class.groupBy("word").agg(F.max_by("cls", F.struct(F.col("a") + F.col("b"), "cls")).alias("cls"))
    folder = words.inputFiles()[0].rsplit("/", 1)[0]
    got = {bytes(r.word): r.cls for r in spark.read.parquet(folder).collect()}
    assert got == {bytes(r.word): r.cls for r in expected.collect()} and len(set(got.values())) > 1


# ---- 7


def brute_rules(text):
    w = WORD.findall(text)
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered)


def test_rule_counts_against_brute_force():
    rng = random.Random(8)
    texts = [x or "" for x in ODD] + ["\n".join(prose(rng, rng.randint(0, 6)) for _ in range(rng.randint(1, 9))) for _ in range(300)] + ["a# b*\na# b*"]
    got = host_rules.rule_counts(pa.array(texts))
    assert list(zip(*(got[c].tolist() for c in host_rules.COUNTS), strict=True)) == [brute_rules(t) for t in texts]


def test_a_bad_host_goes_with_its_documents(spark):
    rng = random.Random(9)
    texts = [prose(rng, 30) if i % 10 == 0 or i >= 60 else "short" for i in range(160)]
    docs = documents(spark, texts, sources=["bad"] * 60 + [None] * 50 + ["good"] * 50)
    got = {r.doc_id: r for r in host_rules.judge(docs).collect()}
    assert not any(got[i].kept for i in range(60)) and all(got[i].kept for i in range(60, 160))
    kept = host_rules.keep_good(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == list(range(60, 160))


def test_hosts_of_symbols_and_hosts_that_stand_out(spark):
    rng = random.Random(18)
    junk = lambda: " ".join(f"{prose(rng, 1)} #$%" for _ in range(20))
    rows = [(f"h{i}", junk() if rng.random() < 0.05 else prose(rng, 30)) for i in range(30) for _ in range(40)]
    for bad, share in (("symbols", 10), ("often", 5)):  # over the fixed rate, and under it but far from the others
        more = [(bad, junk() if i % 10 < share else prose(rng, 30)) for i in range(40)]
        docs = documents(spark, [t for _, t in rows + more], sources=[h for h, _ in rows + more])
        judged = host_rules.judge(docs).filter("not base_failed")
        got = judged.groupBy("host").agg(F.min("kept").alias("low"), F.max("kept").alias("high"), F.max("rate").alias("rate")).collect()
        assert {r.host for r in got if not r.high} == {bad} and all(r.low for r in got if r.host != bad)
    assert max(r.rate for r in got) < 0.5
    clash = docs.withColumnsRenamed({"lang": "counts"}).withColumns({c: F.lit(1) for c in ("doc", "failed", "base_failed")}).withColumn("host", F.lit("h"))
    kept = host_rules.keep_good(clash)
    assert kept.columns == clash.columns and kept.count() == judged.filter("host <> 'often'").count() > 1100


def test_clashing_columns_and_odd_sources(spark):
    """Columns of any name are handed on; a null source is none of the sources by name."""
    texts = ["a b c d"] * 8 + ["e f g h i"] * 4 + ["k l"] * 2
    docs = documents(spark, texts, sources=[None] * 8 + ["\0"] * 4 + ["\0\0"] * 2)
    docs = docs.withColumns({c: F.lit(i) for i, c in enumerate(("doc", "source_", "place", "plan", "pass", "__mix", "_salt", "id"))})
    mix = mixing.Mix(repetition_limit=None, target_entropy=1.0)
    assert {r.source for r in mixing.plan_sources(mixing.slim_table(docs, mix), mix).collect()} == {"\0", "\0\0", "\0\0\0"}
    out = mixing.mix_documents(docs, mix)
    assert sorted(out.columns) == sorted(docs.columns) and {tuple(r)[:3] for r in out.select("doc", "place", "id").collect()} == {(0, 2, 7)}
    assert near_dedup.keep_firsts(docs).columns == docs.columns and pii.mask_documents(docs).columns == docs.columns


def test_mixture_in_order(spark):
    """Blocks follow each other as files, each with all sources in proportion; two runs give the same order."""
    rng = random.Random(19)
    docs = documents(spark, [prose(rng, 10) for _ in range(600)], sources=["x"] * 400 + ["y"] * 200)
    mix = mixing.Mix(repetition_limit=1.2, blocks=8)
    mixed_ = mixing.mix_documents(docs.repartition(3), mix)
    want = [r.doc_id for r in sorted(mixed_.collect(), key=lambda r: (r["__mix"].block, r["__mix"].order, r["__mix"]["pass"]))]
    got = mixing.in_order(mixed_, 8)
    assert got.columns == docs.columns and [r.doc_id for r in got.collect()] == want
    each = got.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.avg((F.col("source") == "y").cast("int")).alias("y")).collect()
    assert len(each) == 8 and max(r.n for r in each) < 2 * min(r.n for r in each) and all(0.15 < r.y < 0.65 for r in each)


# ---- 8


def test_the_sample_depends_on_the_tables_alone(spark):
    """Neither the layout of the rows nor repeated ids change the scores; a bound on the sample holds."""
    rng = random.Random(20)
    texts = [prose(rng, 30) + (" stupid" if i % 3 == 0 else "") for i in range(300)]
    docs = documents(spark, texts + ["zz stupid idiot"] * 40, [*range(300), *[7] * 20, *[None] * 20])
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(0, 300, 2)], "doc_id long, quality int, toxic int")
    one, two = (sorted((r.doc_id is None, r.doc_id or 0, r.score) for r in weak_labels.score(d, weak_labels.fit(d, labels, 50)).collect()) for d in (docs.repartition(5), docs.orderBy(F.desc("text")).coalesce(2)))
    assert [x[:2] for x in one] == [x[:2] for x in two] and [x[2] for x in one] == pytest.approx([x[2] for x in two], abs=1e-9)
    assert len(one) == 340


def test_the_accuracy_of_given_labels_is_estimated():
    """Labels that the labellers contradict in one of five cases are found to be that wrong."""
    rng = np.random.default_rng(1)
    truth = rng.random(30_000) < 0.3
    fires = rng.random((30_000, 5)) < np.where(truth[:, None], 0.8, 0.05)
    given = np.where(rng.random(30_000) < 0.8, truth, ~truth).astype(int)
    key, counts = np.unique(np.stack([(fires << np.arange(5)).sum(1), given]), axis=1, return_counts=True)
    model = weak_labels.fit_labellers(key[0], key[1], counts.astype(float))
    np.testing.assert_allclose(model.given, [0.8, 0.8], atol=0.03)


def test_labellers_against_a_plain_loop():
    """Expectation-maximisation over patterns equals the same done document by document."""
    rng = np.random.default_rng(3)
    truth = rng.random(400) < 0.3
    fires = rng.random((400, 5)) < np.where(truth[:, None], [0.8, 0.5, 0.6, 0.4, 0.7], [0.05, 0.02, 0.1, 0.01, 0.2])
    given = np.where(rng.random(400) < 0.3, truth.astype(int), -1)
    key, counts = np.unique(np.stack([(fires << np.arange(5)).sum(1), given]), axis=1, return_counts=True)
    model = weak_labels.fit_labellers(key[0], key[1], counts.astype(float), rounds=20, trust=50, unlabelled=0.5)
    prior, rates, right = 0.2, [[0.01, 0.3] for _ in range(5)], [0.95, 0.9]
    for _ in range(20):
        sums = {"bad": 0.0, "all": 0.0, "on": [[0.0, 0.0] for _ in range(5)], "said": [0.0, 0.0], "right": [0.0, 0.0]}
        for row, g in zip(fires, given, strict=True):
            odds = [1 - prior, prior]
            for kind in (0, 1):
                for i, on in enumerate(row):
                    odds[kind] *= rates[i][kind] if on else 1 - rates[i][kind]
                if g >= 0:
                    odds[kind] *= right[kind] if g == kind else 1 - right[kind]
            weight = 1.0 if g >= 0 else 0.5
            share = [weight * o / sum(odds) for o in odds]
            sums["bad"] += share[1]
            sums["all"] += weight
            for kind in (0, 1):
                for i, on in enumerate(row):
                    sums["on"][i][kind] += share[kind] * on
                sums["said"][kind] += share[kind] * (g >= 0)
                sums["right"][kind] += share[kind] * (g == kind)
        good = sums["all"] - sums["bad"]
        rates = [[(a + 0.1) / (good + 10), (b + 1) / (sums["bad"] + 5)] for a, b in sums["on"]]
        right = [(sums["right"][k] + 0.95 * 50) / (sums["said"][k] + 50) for k in (0, 1)]
        prior = (sums["bad"] + 1) / (sums["all"] + 5)
    np.testing.assert_allclose(model.rates, rates, rtol=1e-8)
    np.testing.assert_allclose([model.prior, *model.given], [prior, *right], rtol=1e-8)
    on, bias = model.weights()
    np.testing.assert_allclose(1 / (1 + np.exp(-(fires @ on + bias))), model.posterior((fires << np.arange(5)).sum(1)), rtol=1e-8)


def test_telling_words_against_a_plain_count(spark):
    """Words come from the other half's labels, none from too few texts, mixed ones, overlong ones or texts without a label."""
    rng = random.Random(21)
    rows = []
    for i in range(800):
        bad = i % 4 == 0
        words = prose(rng, 30).split() + (["Zorbik!", "x" * 65] if bad else []) + (["plain"] if i % 3 == 0 else []) + (["onlyhere"] if i in (0, 4) else [])
        rows.append((i % 2, int(bad) if i < 790 else -1, None if i == 1 else " ".join(words)))
    rows += [(h, g, t) for h in (0, 1) for g, t in ((-1, "zorbik unlabelled"), (1, None), (0, ""))]
    rows = [((h + g) % 2 if g >= 0 else h, g, t) for h, g, t in rows]
    got = weak_labels.telling_words(spark.createDataFrame(rows, "half int, given int, text string").repartition(4))
    for half in (0, 1):
        known = [(g, t or "") for h, g, t in rows if h == half and g >= 0]
        share = sum(g for g, _ in known) / len(known)
        seen = {}
        for g, t in known:
            for w in {x.lower().strip(".,;:!?\"'()") for x in t.split()}:
                n, b = seen.get(w, (0, 0))
                seen[w] = (n + 1, b + g)
        want = {w for w, (n, b) in seen.items() if w and n >= 5 and len(w) <= 64 and b >= 0.97 * n and 0 < share < 1 and (b - n * share) / (n * share * (1 - share)) ** 0.5 >= 5}
        assert set(got[half]) == want
    assert any("zorbik" in words for words in got)


def test_the_features_of_the_sample_are_bounded(spark):
    """A bound on features leaves whole texts out of the scorer's sample, never parts; without words nothing tells."""
    rng = random.Random(22)
    bad = [i % 3 == 0 for i in range(200)]
    docs = documents(spark, [prose(rng, 3000 if i == 5 else 30) + (" zorbik" if b else "") for i, b in enumerate(bad)])
    labels = spark.createDataFrame([(i, 1, int(b)) for i, b in enumerate(bad)], "doc_id long, quality int, toxic int")
    whole, cut, none = (weak_labels.fit(docs, labels, max_features=n) for n in (1 << 25, 4000, 0))
    assert (whole.weights != cut.weights).any() and whole.telling == cut.telling == none.telling
    on, bias = none.labellers.weights()
    np.testing.assert_allclose(none.weights[:5], on)
    assert none.weights[-1] == bias and not none.weights[5:-1].any()
    unlabelled = weak_labels.fit(docs, labels.limit(0))
    assert unlabelled.telling == ([], []) and weak_labels.score(docs, unlabelled).count() == 200


def test_labellers_are_weighed():
    """Simulated labellers with known rates: the fitted rates and posteriors come close."""
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.3
    rates = np.array([[0.05, 0.8], [0.02, 0.5], [0.1, 0.6], [0.01, 0.4], [0.2, 0.7]])
    fires = rng.random((20_000, 5)) < np.where(truth[:, None], rates[:, 1], rates[:, 0])
    votes = (fires << np.arange(5)).sum(1)
    given = np.where(rng.random(20_000) < 0.05, truth.astype(int), -1)
    key, counts = np.unique(np.stack([votes, given]), axis=1, return_counts=True)
    model = weak_labels.fit_labellers(key[0], key[1], counts.astype(float))
    np.testing.assert_allclose(model.rates, rates, atol=0.05)
    assert ((model.posterior(votes) > 0.5) == truth).mean() > 0.9


def test_classifier_on_planted_abuse(spark):
    rng = random.Random(10)
    bad = [i % 4 == 0 for i in range(1600)]
    texts = [prose(rng, 40) + (" zorbik stupid " if b and i % 8 == 0 else " zorbik " if b else " ") + prose(rng, 10) for i, b in enumerate(bad)]
    docs = documents(spark, texts + [None, ""])
    labels = spark.createDataFrame([(i, 1, int(b)) for i, b in enumerate(bad[:1200])] + [(0, 1, 1), (None, 0, 0), (5, None, None), (99999, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in weak_labels.score(docs, weak_labels.fit(docs, labels)).collect()}
    assert np.mean([got[i].kept != bad[i] for i in range(1200, 1600)]) > 0.97
    assert len(got) == 1602 and got[1600].score == got[1601].score


# ---- 9


def test_archives_round_trip(spark, tmp_path):
    rng = random.Random(11)
    big = prose(rng, 400)
    pages = [(0, "u", None), (1, None, big), (2, "http://x/ü\r\n", big), (None, "n", big), (3, "%0A", "small"), (4, "v", "small"), (5, "w", "é" * 600), *((i, f"u{i}", prose(rng, rng.randint(1, 300))) for i in range(6, 60))]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    archives = warc.write_warc(warc.plan_revisits(table.repartition(3)), f"file://{tmp_path}/a", archive_bytes=300)
    records = warc.read_warc(archives).collect()
    assert archives.count() > 3 and len(records) == len(pages) and not any(r.error for r in records)
    assert warc.read_warc(warc.archives_in(spark, f"file://{tmp_path}/a")).count() == len(pages)
    got = {r.page_id: r for r in records}
    for i, url, html in pages:
        data, r = (html or "").encode(), got[i]
        assert (r.payload_bytes, r.payload_digest, r.url) == (len(data), hashlib.sha1(data).hexdigest(), url or "")
        again = html == big and i != 2
        assert (r.record_type, r.refers_to) == (("revisit", 2) if again else ("response", None))
        assert r.payload is None if again else bytes(r.payload) == data


def test_damaged_records_are_told():
    import io

    good = warc.record_bytes(1, "u", b"x" * 50, hashlib.sha1(b"x" * 50).hexdigest(), None, False)
    assert warc.parse_record(good)["error"] is None
    assert warc.parse_record(good.replace(b"x" * 50, b"x" * 49 + b"y"))["error"] == "payload digest"
    assert warc.parse_record(good[:-1])["error"] == "block length"
    assert warc.parse_record(good.replace(b"WARC/1.1", b"WARC/9"))["error"]
    assert warc.parse_record(good.replace(b"WARC-Date", b"X"))["error"] == "no warc-date"
    sink = io.BytesIO()
    warc.write_archive(sink, iter([good] * 5), warc.make_dictionary([good] * 5, 512), 1 << 20)
    data = sink.getvalue()
    assert [d for _, d, _ in warc.read_archive(io.BytesIO(data), 64)] == [good] * 5
    *_, (_, last, error) = warc.read_archive(io.BytesIO(data[:-3]))
    assert last is None and error


def test_compressed_dictionary_is_read():
    import io
    import struct

    import zstandard

    content = zstandard.ZstdCompressionDict(b"WARC/1.1 abc" * 9, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    packed = zstandard.ZstdCompressor().compress(content.as_bytes())
    data = struct.pack("<II", warc.SKIPPABLE, len(packed)) + packed + zstandard.ZstdCompressor(dict_data=content).compress(b"WARC/1.1 abcabc")
    assert [d for _, d, _ in warc.read_archive(io.BytesIO(data))] == [b"WARC/1.1 abcabc"]


# ---- 10


def brute_components(ids, texts):
    sets = {}
    for i, t in zip(ids, texts, strict=True):
        w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in WORD.findall(t or "")]
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    comp = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if a < b and sets[a] and sets[b] and comp[a] != comp[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
                    changed = True
    return {i: (len(sets[i]), comp[i]) for i in ids}


@pytest.mark.parametrize("leaf", [1500, 6])
def test_components_against_brute_force(spark, monkeypatch, leaf):
    """With tiny leaves the large-node branching is what finds the links."""
    monkeypatch.setattr(near_dedup, "LEAF", leaf)
    rng = random.Random(12)
    base = [prose(rng, 60).split() for _ in range(6)]
    texts = list(ODD)
    for i in range(90):
        words = list(base[i % 6])
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(999)}"
        texts.append(" ".join(words).upper() if i % 9 == 0 else " ".join(words))
    texts += [prose(rng, rng.randint(1, 7)) for _ in range(20)]
    ids = rng.sample(range(500), len(texts))
    docs = documents(spark, texts, ids)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.find_components(docs).collect()}
    assert got == brute_components(ids, texts)
    kept = near_dedup.keep_firsts(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in got.items() if c == i)


def test_texts_of_one_id_are_one_document(spark):
    texts = [" ".join(f"{k}{i}" for i in range(30)) for k in "abcdefg"]
    rows = [(1, 0), (2, 1), (3, 0), (3, 1), (4, 2), (4, 2), (5, 3), (6, 4), (6, 5), (7, 5), (8, None), (8, 3), (0, 6), (9, 6), (9, 2)]
    docs = documents(spark, [None if t is None else texts[t] for _, t in rows], [i for i, _ in rows])
    got = {(r.doc_id, r.component_id) for r in near_dedup.find_components(docs.repartition(4)).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 0), (5, 5), (6, 6), (7, 6), (8, 5), (0, 0), (9, 0)}
    assert near_dedup.find_components(docs).count() == len(rows)
    kept = sorted(r.doc_id for r in near_dedup.keep_firsts(docs).collect())
    assert kept == [0, 1, 5, 6, 6]


def test_near_copies_of_further_texts_of_an_id(spark):
    words = [[f"{k}{i}" for i in range(60)] for k in "abc"]
    near = [" ".join([*w[:-1], "other"]) for w in words]
    docs = documents(spark, [" ".join(words[0]), " ".join(words[1]), near[0], near[1], near[2], " ".join(words[2])], [5, 5, 6, 7, 8, 9])
    assert {(r.doc_id, r.component_id) for r in near_dedup.find_components(docs).collect()} == {(5, 5), (6, 5), (7, 5), (8, 8), (9, 8)}


def indexed_components(ids, texts):
    """As brute_components, over an index of shingles, for thousands of documents."""
    sets, held = {}, defaultdict(list)
    for i, t in zip(ids, texts, strict=True):
        w = t.split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))
    for i, x in sets.items():
        for g in x:
            held[g].append(i)
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    for i, x in sets.items():
        for j, n in Counter(j for g in x for j in held[g] if j < i).items():
            if root(i) != root(j) and 100 * n >= 75 * (len(x) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("leaf", [1500, 12])
def test_recall_on_thousands_of_documents(spark, monkeypatch, leaf):
    """5,000 documents in groups of one to hundreds at all likenesses, some near the threshold: no component differs in 99 of 100."""
    monkeypatch.setattr(near_dedup, "LEAF", leaf)
    rng = random.Random(16)
    texts = []
    while len(texts) < 5000:
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(30, 90))]
        for _ in range(min(rng.choice([1, 1, 1, 2, 3, 8, 40, 200]), 5000 - len(texts))):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 25))):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    ids = rng.sample(range(10**6), len(texts))
    want = indexed_components(ids, texts)
    got = {r.doc_id: r.component_id for r in near_dedup.find_components(documents(spark, texts, ids)).collect()}
    same = sum(got[i] == c for i, c in want.items())
    assert same >= 0.99 * len(ids), same


def test_a_large_group_at_lower_likeness_does_not_multiply(spark, monkeypatch):
    """3,000 texts that differ in two words each, pairwise at 0.87 or so, with LEAF as it is: rows never grow."""
    rng = random.Random(21)
    base = [f"w{i}" for i in range(300)]
    texts = []
    for n in range(3000):
        words = list(base)
        for k in rng.sample(range(300), 2):
            words[k] = f"own{n}.{k}"
        texts.append(" ".join(words))
    texts += [" ".join(base[:150] + [f"far{n}.{i}" for i in range(150)]) for n in range(400)]
    sizes = []
    kept = near_dedup.stash

    def watched(df, name="table"):
        out = kept(df, name)
        if name in ("roots", "paths", "leaves"):
            sizes.append((name, out.agg(F.sum(F.size("nodes"))).first()[0]))
        return out

    monkeypatch.setattr(near_dedup, "stash", watched)
    began = time.time()
    got = {r.doc_id: r.component_id for r in near_dedup.find_components(documents(spark, texts).repartition(4)).collect()}
    assert time.time() - began < 120
    assert got == {i: 0 if i < 3000 else i for i in range(3400)}
    assert max(n for _, n in sizes) <= 2 * sizes[0][1], sizes


def test_large_groups_of_two_variants_end(spark, monkeypatch):
    """Two variants of a text, unlike each other but for a few between them, in nodes far over LEAF."""
    monkeypatch.setattr(near_dedup, "LEAF", 16)
    rng = random.Random(17)
    common = [f"c{i}" for i in range(170)]
    first, second = ([*common, *(f"{k}{i}" for i in range(40))] for k in "ab")
    texts = []
    for n in range(160):
        words = list(first if n % 2 else second)
        words[rng.randrange(170)] = f"serial{n}"
        texts.append(" ".join(words))
    texts.append(" ".join([*common, *(f"a{i}" for i in range(20)), *(f"b{i}" for i in range(20, 40))]))
    want = indexed_components(range(len(texts)), texts)
    got = {r.doc_id: r.component_id for r in near_dedup.find_components(documents(spark, texts)).collect()}
    assert got == want


def test_trees_follow_the_recall():
    assert [near_dedup.trees_for(x) for x in (0.75, 0.9, 0.99, near_dedup.TARGET_RECALL, 1.0)] == [1, 2, 4, 12, 25]


def test_null_ids(spark):
    got = near_dedup.find_components(documents(spark, ["a b c d e f", "A b c d e f", "z"], [None, 4, 5])).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.component_id, r.kept) for r in got) == [(False, 4, None, False), (False, 5, 5, True), (True, 0, None, True)]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 200), (3, 2)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long"), len(edges)).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}, 200: 200}


# ---- shared


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_broadcast(spark, how):
    big = spark.range(500).select((F.col("id") % 7).alias("k"), "id", F.array("id").alias("a"))
    small = spark.createDataFrame([(0, "x"), (3, "y"), (99, "z")], "k long, v string")
    one, two = (sorted(map(str, keyed_join(big, small, "k", 3, how, limit=n).collect())) for n in (10, 0))
    assert one == two and one


def test_operators_with_salted_joins(spark, monkeypatch):
    """Beyond the broadcast limit every operator joins by key and salt, with the same rows."""
    import functools

    docs, pages = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "pages"))

    def results():
        return [
            sorted(map(str, near_dedup.find_components(docs).collect())),
            sorted(map(str, mixing.mix_documents(docs).select("doc_id", "__mix").collect())),
            sorted(map(str, host_rules.judge(docs).drop("rate").collect())),
            sorted(map(str, warc.plan_revisits(pages).drop("payload").collect())),
        ]

    want = results()
    for module in (near_dedup, components, mixing, host_rules, warc):
        monkeypatch.setattr(module, "keyed_join", functools.partial(keyed_join, limit=0))
    assert results() == want


def test_written_tables_lie_in_the_shared_folder(spark):
    table = stash(spark.range(3), "t")
    assert table.inputFiles()[0].startswith(spark.sparkContext.getConf().get("spark.checkpoint.dir").replace("file://", "file:")) or "shared" in table.inputFiles()[0]


def test_stashes_are_cleared(spark, monkeypatch):
    from seqmill.llm import common

    monkeypatch.setattr(common, "_written", {})
    table = stash(spark.range(3), "gone")
    files = table.inputFiles()
    assert common.clear_stashes(spark) == 1 and common.clear_stashes(spark) == 0
    assert not any(spark.sparkContext._jvm.java.io.File(f.removeprefix("file://")).exists() for f in files) and files


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from seqmill.llm.common import shared_folder

    unset = SimpleNamespace(getConf=lambda: {}, getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(ValueError, match="checkpoint.dir"):
        shared_folder(SimpleNamespace(sparkContext=unset))


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Empty and null tables, repeated rows, further and clashing columns pass all stages."""
    import corpus_pipeline

    rng = random.Random(23)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(30_000))
    some = documents(spark, [None, "", "a b", prose(rng, 40), "z " * 3, long, *[prose(rng, 30)] * 3], [None, 1, 2, 3, 4, 5, 6, 6, None], [None, "s", "\0", "s", "t", None, "s", "s", "s"]).withColumn("doc", F.lit(1)).withColumn("place", F.lit("x"))
    for name, docs in (("empty", some.limit(0)), ("odd", some)):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        rows = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert bool(rows) == (name == "odd")
    assert {r.doc_id for r in rows} >= {3, 5} and {r.doc_id for r in rows} <= {None, 3, 5, 6}


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stash(stage(spark, docs, SMALL), name)
        seen[name] = out
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        docs = out
    good = {r.doc_id for r in seen["quality_rules"].collect()}
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    assert good == {r.doc_id for r in rows if (b := brute_rules(r.text))[0] >= 10 and 100 * b[4] <= 20 * b[0]}
    texts = {r.doc_id: r.text for r in rows if r.doc_id in good}
    firsts = {i for i, (_, c) in brute_components(sorted(texts), [texts[i] for i in sorted(texts)]).items() if i == c}
    assert {r.doc_id for r in seen["near_duplicates"].collect()} == firsts
    masked = {r.doc_id: r.text for r in seen["personal_data"].collect()}
    assert masked == {i: pii.mask(texts[i], pii.find_spans(texts[i])) for i in firsts} and not any(plain_spans(t) for t in masked.values() if "@" in t)
    assert {r.doc_id for r in seen["source_mixing"].collect()} == firsts
    tokens = sum(len(packing.token_ids(r.text, packing.default_ranks())) for r in seen["source_mixing"].collect())
    assert seen["sequence_packing"].agg(F.sum("length")).first()[0] == tokens
    assert sorted(map(str, corpus_pipeline.run(spark, SMALL).drop("sequence_id", "offset").collect())) == sorted(map(str, seen["sequence_packing"].drop("sequence_id", "offset").collect()))
