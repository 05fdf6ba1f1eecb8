"""Every operator against a plain version, with nulls, empty and long texts, ties, repeated rows, clashing columns, empty tables."""
import hashlib
import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from recoflow.llm import (bpe, decontaminate, kn_quality, language_id, license_scan, ngram_join, quality_rules, suffix_dedup,
                          token_counts, url_filter)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, kept string, ord string, spans string, c0 string"
RNG = random.Random(11)
WORDS = ["the", "of", "and", "Ééan", "threa", "onen", "tion", "x1", "größe", "it's", "über"]


def prose(n):
    return " ".join(RNG.choice(WORDS) + RNG.choice(["", "", "", ".", "\n"]) for _ in range(n))


def _texts():
    base = [prose(RNG.randint(25, 90)) for _ in range(14)]
    near = [" ".join([*b.split(" ")[:-1], "end"]) for b in base[:4]]
    passage = prose(60)
    around = [f"{prose(20)} {passage} {prose(20)}" for _ in range(5)]
    odd = [None, "", "   ", "\n\n", "one", "two words", "...", "🙂" * 60, "a" * 400, "ab" * 300, "Und " * 80, prose(6000), "<|endoftext|>a <|endoftext|>"]
    return base + base[:3] + near + around + odd


TEXTS = _texts()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, RNG.choice(["en", "de", None]), RNG.choice(["s0", "s1", None]), len(t or ""), 0, "x", "y", "z", "w") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd(spark, docs):
    """The same with a null id, a repeated row and an id with two texts."""
    extra = [(None, TEXTS[0], "en", "s0", 1, 0, "x", "y", "z", "w"), (3, TEXTS[3], None, None, 1, 0, "x", "y", "z", "w"), (5, "another text of the same id", "en", "s0", 1, 0, "x", "y", "z", "w")]
    return docs.unionByName(spark.createDataFrame(extra, SCHEMA))


@pytest.fixture(scope="module")
def bench(spark):
    rows = [(1, " ".join(TEXTS[5].split()[3:20])), (2, "two words"), (2, "two words"), (3, None), (4, "..."), (None, "one"), (10, " ".join(TEXTS[6].split()[:12]))]
    return spark.createDataFrame(rows, "item_id long, text string")


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_suffix_order_and_prefixes():
    for _ in range(40):
        parts = [bytes(RNG.choice(b"abc") for _ in range(RNG.randint(1, 40))) for _ in range(RNG.randint(1, 8))]
        text = np.frombuffer(b"\xff".join(parts) + b"\xff", np.uint8) + np.uint8(1)
        order = suffix_dedup.two_stage_order(text, 12)
        keys = [bytes(text[i:i + 12]).split(b"\0")[0] for i in order]
        assert sorted(order.tolist()) == list(range(len(text))) and keys == sorted(keys)
        for k, n in enumerate(suffix_dedup.neighbour_prefixes(text, order, 12)[1:], 1):
            a, b = keys[k - 1], keys[k]
            assert n == next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))


def _removed(rows):
    out = {}
    for d, mask in brute.removed_mask(rows).items():
        b = dict(rows)[d]
        rest = bytes(x for x, gone in zip(b, mask) if not gone)
        spans = sum(g and not (i and mask[i - 1]) for i, g in enumerate(mask))
        out[d] = (len(b), sum(mask), spans, hashlib.sha256(rest).hexdigest())
    return out


@pytest.mark.parametrize("heavy", [False, True])
def test_suffix_dedup(docs, monkeypatch, heavy):
    if heavy:  # anchors with several stretches go round string by string
        monkeypatch.setattr(suffix_dedup, "HEAVY_LEAST", 2)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.deduplicate(docs).collect()}
    assert got == _removed([(i, (t or "").encode()) for i, t in enumerate(TEXTS)])


def test_suffix_dedup_odd_rows(spark, docs, odd):
    assert suffix_dedup.deduplicate(odd).count() == len(TEXTS) + 3
    by = {r.doc_id: r for r in suffix_dedup.deduplicate(odd).where("doc_id is null or doc_id in (0, 3)").collect()}
    assert by[None].n_removed == 0 and by[0].n_removed == by[0].n_bytes  # the null id comes first
    assert suffix_dedup.deduplicate(empty(spark)).count() == 0
    assert suffix_dedup.remove_repeats(docs).columns == docs.columns


@pytest.mark.parametrize("flush", [400_000, 1])
@pytest.mark.parametrize("heavy", [False, True])
def test_suffix_dedup_repeated_rows(spark, monkeypatch, heavy, flush):
    """Rows that share doc_id and text are one document: only what starts earlier goes, from each of them."""
    monkeypatch.setattr(suffix_dedup, "FLUSH", flush)  # 1: each row is a flush of its own
    if heavy:
        monkeypatch.setattr(suffix_dedup, "HEAVY_LEAST", 2)
    rng = random.Random(3)
    say = lambda n: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))
    a, b, shared = say(60), say(60), say(30)
    rows = [(1, a), (2, f"{say(20)} {shared} {say(20)}"), (3, b), (4, f"{say(25)} {shared} {say(15)}"), (5, a), (6, f"{b} {b}")]
    repeated = [*rows, rows[0], rows[0], rows[1], rows[3], rows[4], rows[5]]
    want = _removed([(i, t.encode()) for i, t in rows])
    docs = spark.createDataFrame(repeated, "doc_id long, text string")
    for parts in (1, 4):
        got = [(r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in suffix_dedup.deduplicate(docs.repartition(parts)).collect()]
        assert sorted(got) == sorted((i, want[i]) for i, _ in repeated)
    assert want[1][1] == 0 and want[2][1] == 0 and want[5][1] == want[5][0] and 0 < want[4][1] < want[4][0]
    assert sorted(r.doc_id for r in suffix_dedup.remove_repeats(docs).collect()) == sorted(i for i, _ in repeated if i != 5)


def test_suffix_dedup_holds_little(docs, monkeypatch):
    """Arrow batches are small while the tables are written, and the session's number comes back; the last step goes by parts of a batch."""
    spark, key, seen = docs.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch", {}
    was, writes = spark.conf.get(key), suffix_dedup.written
    monkeypatch.setattr(suffix_dedup, "BATCH", 7)
    monkeypatch.setattr(suffix_dedup, "written", lambda df, name: (seen.update({name: int(spark.conf.get(key))}), writes(df, name))[1])
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.deduplicate(docs).collect()}
    assert got == _removed([(i, (t or "").encode()) for i, t in enumerate(TEXTS)])
    assert set(seen) == {"anchor-counts", "stretches", "spans"} and max(seen.values()) == 7 and spark.conf.get(key) == was
    rows = [b.num_rows for b in suffix_dedup._parts(iter([pa.RecordBatch.from_arrays([pa.array(range(20))], names=["x"])]))]
    assert rows == [7, 7, 6]
    assert suffix_dedup.FLUSH <= 1 << 17


def test_suffix_dedup_odd_rows_keep_repeated(odd):
    got = [(r.n_removed, r.kept_sha256) for r in suffix_dedup.deduplicate(odd).where("doc_id = 3").collect()]
    assert got == [(0, hashlib.sha256(TEXTS[3].encode()).hexdigest())] * 2


def test_rows_without_id_are_told_apart(spark):
    """Texts without an id whose hashes share the highest 24 bits are different documents."""
    import xxhash
    seen, pair = {}, None
    for i in range(200_000):
        text = " ".join(f"w{(i * k) % 9973}" for k in range(1, 41))
        top = xxhash.xxh64(text.encode(), seed=42).intdigest() >> 40
        if top in seen and seen[top] != text:
            pair = (seen[top], text)
            break
        seen[top] = text
    rows = spark.createDataFrame([(None, pair[0]), (None, pair[1]), (None, pair[1])], "doc_id long, text string")
    got = sorted((r.n_bytes, r.n_removed) for r in suffix_dedup.deduplicate(rows).collect())
    assert got == sorted([(len(pair[0]), 0), (len(pair[1]), 0), (len(pair[1]), 0)])
    kept = [r.text for r in ngram_join.representatives(rows, size=corpus_pipeline.SHINGLE, pct=corpus_pipeline.SIMILAR).collect()]
    assert sorted(kept) == sorted(pair)


def test_quality_base_counts(docs):
    got = {r.doc_id: tuple(r)[1:7] for r in quality_rules.verdicts(docs).select("doc_id", *quality_rules.COUNTS, "base_failed").collect()}
    assert got == {i: brute.base_counts(t) for i, t in enumerate(TEXTS)}


def test_quality_estimates_and_outliers(spark):
    rows = [(i, prose(80), "en", "s0") for i in range(300)] + [(1000 + i, " ".join(w + "$$$" for w in prose(80).split()).upper(), "en", "s0") for i in range(60)]
    got = {r.doc_id: r.kept for r in quality_rules.verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert sum(got[i] for i in range(300)) >= 297 and not any(got[1000 + i] for i in range(60))


def test_quality_estimates_nearly_half_junk(spark):
    """Sources of which 30 to 45 % are junk, one of them small, and one without junk."""
    rows, junk = [], set()
    for source, n, share in (("a", 300, 30), ("b", 300, 40), ("c", 300, 45), ("small", 80, 40), ("clean", 300, 0)):
        for i in range(n):
            text = prose(80)
            if 100 * i < share * n:
                junk.add(len(rows))
                text = " ".join(w + "$" * RNG.randint(1, 4) if RNG.random() < 0.7 else w.upper() for w in text.split())
            rows.append((len(rows), text, "en", source))
    got = {r.doc_id: r.kept for r in quality_rules.verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(got[i] for i in junk) and sum(got.values()) >= 0.99 * (len(rows) - len(junk))


def test_quality_filter_keeps_columns(spark, odd):
    out = quality_rules.filter_documents(odd)
    assert out.columns == odd.columns and out.count() == quality_rules.verdicts(odd).where("kept").count()
    assert quality_rules.verdicts(empty(spark)).count() == 0


def test_ngram_join(docs):
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs).collect())
    assert got == sorted(brute.jaccard_components(list(enumerate(TEXTS))))


def test_ngram_join_common_passage(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"{passage} " + " ".join(f"q{i}_{k}" for k in range(i % 14))) for i in range(120)]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted(brute.jaccard_components(rows))


def test_ngram_join_edited_copies(spark):
    """Copies with a few edits of their own: some link to the first text only, some to each other only, some to none."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.choice([3, 20, 41, 60, 77])] = f"e{rng.randint(0, 6)}"
        rows.append((i, " ".join(words[: rng.choice([80, 80, 76, 70])])))
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted(brute.jaccard_components(rows)) and len({r[2] for r in got}) > 2


def test_ngram_join_holds_little(docs, monkeypatch):
    """A task packs its signatures every HELD of them; Arrow batches are small while the tables are written, and the session's number comes back."""
    monkeypatch.setattr(ngram_join, "HELD", 500)
    batch = pa.RecordBatch.from_arrays([pa.array([t or "" for t in TEXTS])], names=["text"])
    signed = [len(ngram_join.signatures(s, 80)) for s in ngram_join.shingle_sets(batch.column(0), 5)]
    packed = [b for b in ngram_join._signature_rows(5, 80, 1)(iter([batch]))]
    heads = [body for b in packed for kind, body in zip(b.column(1).to_pylist(), b.column(2).to_pylist()) if kind == ngram_join._HEADS]
    assert len(heads) > 2 and max(len(ngram_join._unpacked_heads(x)[0]) for x in heads) <= 500 + max(signed)
    spark, key, seen = docs.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch", []
    was, writes = spark.conf.get(key), ngram_join.written
    monkeypatch.setattr(ngram_join, "written", lambda df, name: (seen.append(int(spark.conf.get(key))), writes(df, name))[1])
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs).collect())
    assert got == sorted(brute.jaccard_components(list(enumerate(TEXTS))))
    assert seen and max(seen) <= ngram_join.BATCH and spark.conf.get(key) == was


def test_ngram_join_odd_rows(spark, odd):
    out = ngram_join.jaccard_components(odd).collect()
    assert len(out) == len(TEXTS) + 3
    assert {r.component_id for r in out if r.doc_id in (0, None)} == {None}
    kept = ngram_join.representatives(odd)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == odd.columns and ids.count(3) == 1 and ids.count(5) == 2 and 0 not in ids and None in ids
    assert ngram_join.jaccard_components(empty(spark)).count() == 0 and ngram_join.representatives(empty(spark)).count() == 0


def test_pipeline_near_duplicates(spark):
    """Groups that only link at five words and 0.80 to 0.85, and pairs just below 0.8."""
    rows = []
    for g in range(12):
        words = [f"g{g}w{i}" for i in range(100 if g % 2 else 200)]
        if g % 2:  # 96 / 116 up to 96 / 124
            other = words + [f"g{g}x{i}" for i in range(20 + 2 * (g // 4) * 2)]
        else:  # 176 / 216, 171 / 221
            other = [f"e{g}" if i in [20, 60, 100, 140, 180][: 4 + g // 6] else w for i, w in enumerate(words)]
        rows += [(10 * g, " ".join(words)), (10 * g + 1, " ".join(other))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    want = sorted(d for d, _, c in brute.jaccard_components(rows, 5, 80) if c == d)
    assert got == want and 13 < len(want) < 23 and 1 not in got and 11 not in got
    assert len({c for _, _, c in brute.jaccard_components(rows)}) == len(rows)  # none links at op7's four words and 0.85


def test_signatures_cover_linked_pairs():
    rng = np.random.default_rng(4)
    for n in [1, 5, 7, 12, 20, 40, 90, 200, 600]:
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        for _ in range(20):
            drop, add = rng.integers(0, n // 12 + 1, 2)
            b = np.unique(np.concatenate((rng.permutation(a)[drop:], rng.integers(0, 2**63, add, dtype=np.uint64))))
            inter = len(np.intersect1d(a, b))
            if 100 * inter >= 85 * (len(a) + len(b) - inter):
                assert len(np.intersect1d(ngram_join.signatures(a, 85), ngram_join.signatures(b, 85)))
            bits = sum(int(x).bit_count() for x in (ngram_join.parity(a, 256) ^ ngram_join.parity(b, 256)).view(np.uint64))
            assert bits <= len(a) + len(b) - 2 * inter


def test_decontaminate(spark, docs, odd, bench):
    items = [(r.item_id, r.text) for r in bench.collect()]
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.contamination(docs, bench).collect()}
    for d, words, hit, found in brute.contamination(list(enumerate(TEXTS)), items):
        names = sorted("null" if x is None else str(x) for x in found)
        assert got[d] == (words, hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), hit > 0)
    clean = decontaminate.clean_documents(odd, bench)
    assert clean.columns == odd.columns and decontaminate.contamination(clean, bench).where("contaminated and doc_id in (5, 6)").count() == 0
    assert decontaminate.contamination(empty(spark), bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).where("contaminated").count() == 0


def test_decontaminate_in_shards(docs, bench, monkeypatch):
    whole = sorted(map(str, decontaminate.contamination(docs, bench).collect()))
    cleaned = sorted(map(str, decontaminate.clean_documents(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 60)
    assert len(decontaminate._shards(bench, "item_id", "text")) > 2
    assert sorted(map(str, decontaminate.contamination(docs, bench).collect())) == whole
    assert sorted(map(str, decontaminate.clean_documents(docs, bench).collect())) == cleaned


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(bpe.tokenizer_path("byte_bpe_50k.json"))


def test_bpe_and_counts(spark, docs, odd, library):
    got = {r.doc_id: r for r in bpe.encode_documents(docs, ["doc_id"], with_ids=True).collect()}
    counts = {r.doc_id: r for r in token_counts.count_tokens(docs, ["doc_id"], limit=50).collect()}
    for i, t in enumerate(TEXTS):
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert (got[i].n_tokens, got[i].ids) == (len(ids), ids) and back == (t or "") == bpe.decode_ids(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()
        assert (counts[i].n_bytes, counts[i].n_tokens, counts[i].over_limit) == (len((t or "").encode()), len(ids), len(ids) > 50)
    assert bpe.encode_documents(odd, ["doc_id"]).count() == token_counts.count_tokens(odd, ["doc_id"]).count() == len(TEXTS) + 3
    assert bpe.encode_documents(empty(spark), ["doc_id"]).count() == token_counts.count_tokens(empty(spark), ["doc_id"]).count() == 0


def test_bpe_random_texts(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 50)
    monkeypatch.setattr(token_counts, "CACHE", 50)
    alphabet = list("abzAZ019' \n\t\r\x1c\x1f\x00.,!?-_<|>$#éßÉ中🙂́½²") + ["\u0085", " ", " ", "　", "₏", "'s", "'re", "  ", "<|endoftext|>", " the"]
    texts = ["".join(RNG.choice(alphabet) for _ in range(RNG.randint(0, 40))) for _ in range(3000)]
    coder, lengths = bpe.ForcedBpe(bpe.tokenizer_path("byte_bpe_50k.json")), token_counts.Lengths(bpe.tokenizer_path("byte_bpe_50k.json"), {" the": 1})
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert list(lengths.counts(texts)) == [len(x) for x in want]
    assert [coder.encode(t.encode())[1][:-1].decode() for t in texts] == [",".join(map(str, x)) for x in want]


def test_language_mixture(spark, odd):
    voc = {"en": ["the", "thing", "wherever", "shall"], "de": ["der", "nicht", "schön", "über"], "fr": ["le", "été", "quoi", "jamais"]}
    say = lambda lang, n: " ".join(RNG.choice(voc[lang]) for _ in range(n))
    rows = [(i, say(x, 30), x) for i in range(240) for x in [RNG.choice(list(voc))]]
    d = spark.createDataFrame([*rows, (900, say("en", 60) + " " + say("de", 30), None), (901, None, "en"), (902, "123 … !", "en"), (903, "", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.identify(d).collect()}
    assert all(got[i].lang_pred == x for i, _, x in rows) and all(0 <= r.score <= 1 for r in got.values())
    assert {m.lang for m in got[900].mixture} == {"en", "de"} and got[900].lang_pred == "en"
    assert {got[k].lang_pred for k in (901, 902, 903)} == {"und"}
    assert language_id.identify(odd).count() == len(TEXTS) + 3 and language_id.identify(empty(spark)).count() == 0
    assert {r.lang_pred for r in language_id.identify(d.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_mixture_of_many(spark):
    """A text of five or seven languages keeps them all; one of a single language keeps one."""
    voc = {f"l{k}": ["".join(chr(97 + (5 * k + RNG.randrange(5)) % 26) for _ in range(6)) for _ in range(8)] for k in range(7)}
    say = lambda lang, n: " ".join(RNG.choice(voc[lang]) for _ in range(n))
    rows = [(i, say(f"l{i % 7}", 40), f"l{i % 7}") for i in range(280)]
    tests = [(1000 + n, " ".join(say(f"l{k}", 40) for k in range(n)), None) for n in (1, 2, 5, 7)]
    got = {r.doc_id: r for r in language_id.identify(spark.createDataFrame([*rows, *tests], "doc_id long, text string, lang string")).collect()}
    for n in (1, 2, 5, 7):
        share = {m.lang: m.share for m in got[1000 + n].mixture}
        assert set(share) == {f"l{k}" for k in range(n)} and all(abs(x - 1 / n) < 0.05 for x in share.values())


def _kn_brute(texts):
    """Interpolated modified Kneser-Ney over code points from its definition: p of a tuple's last symbol after the others."""
    from collections import Counter, defaultdict
    order = kn_quality.ORDER
    counts = {order: Counter()}
    for t in texts:
        s = " " * (order - 1) + (t or "")
        counts[order].update(s[i:i + order] for i in range(len(s) - order + 1))
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    after, disc = {}, {}
    for n, c in counts.items():
        k = [sum(v == x for v in c.values()) for x in (1, 2, 3, 4)]
        y = k[0] / (k[0] + 2 * k[1]) if all(k) else 0
        disc[n] = [min(max(x - (x + 1) * y * k[x] / k[x - 1], 0.05), float(x)) for x in (1, 2, 3)] if all(k) else [0.5, 1.0, 1.5]
        after[n] = defaultdict(list)
        for g, v in c.items():
            after[n][g[:-1]].append(v)

    def p(g):
        if not g:
            return 1 / 0x110000
        seen = after[len(g)].get(g[:-1])
        if not seen:
            return p(g[1:])
        d = lambda v: disc[len(g)][min(v, 3) - 1] if v else 0.0
        v = counts[len(g)].get(g, 0)
        return (v - d(v)) / sum(seen) + sum(map(d, seen)) / sum(seen) * p(g[1:])
    return p


@pytest.mark.parametrize("nodes", [1 << 21, 300, 0])
def test_kneser_ney(spark, docs, odd, monkeypatch, nodes):
    """Every document's perplexity equals the plain model's of the other fold, with the model broadcast whole, in part, or not at all."""
    monkeypatch.setattr(kn_quality, "NODES", nodes)
    monkeypatch.setattr(kn_quality, "FLUSH", 500)
    labels = spark.createDataFrame([(i, 1) for i in range(14)] + [(0, 0), (None, 1)], "doc_id long, quality int")
    got = kn_quality.judge(odd, labels).collect()
    assert len(got) == len(TEXTS) + 3 and all((r.perplexity is None) == (r.n_symbols == 0) for r in got)
    folds = {r.t: r.f for r in odd.select(F.coalesce("text", F.lit("")).alias("t")).select("t", F.pmod(F.xxhash64("t"), F.lit(2)).alias("f")).collect()}
    known = [r.text or "" for r in odd.where("doc_id between 1 and 13").collect()]
    p = [_kn_brute([t for t in known if folds[t] == f]) for f in (0, 1)]

    def perplexity(text):
        s, lead = " " * (kn_quality.ORDER - 1) + text, kn_quality.ORDER - 1
        return float(np.exp(-np.mean([np.log(p[1 - folds[text]](s[i - lead:i + 1])) for i in range(lead, len(s))])))

    want = {}
    for r in odd.collect():
        want.setdefault(r.doc_id, []).append(perplexity(r.text) if r.text else None)
    mine = {}
    for r in got:
        mine.setdefault(r.doc_id, []).append(r.perplexity)
    assert set(mine) == set(want)
    for i, x in want.items():
        assert sorted(mine[i], key=str) == [v if v is None else pytest.approx(v, rel=1e-5) for v in sorted(x, key=str)]


def test_kneser_ney_empty(spark, docs, odd):
    labels = spark.createDataFrame([(i, 1) for i in range(14)], "doc_id long, quality int")
    clash = docs.withColumns({c: F.lit("x") for c in ("key", "fold", "r", "g", "m", "total", "one", "low", "perplexity")})
    assert sorted(map(str, kn_quality.judge(clash, labels).collect())) == sorted(map(str, kn_quality.judge(docs, labels).collect()))
    assert kn_quality.judge(empty(spark), labels).count() == 0 and kn_quality.judge(docs, labels.limit(0)).where("kept").count() > 20


def test_code_points():
    for texts in (["", "aé", "🙂", "", "x\0y", "中文 ab", ""], ["plain", ""]):
        raw = [t.encode() for t in texts]
        cp, off = kn_quality.code_points(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        assert ["".join(map(chr, cp[a:b])) for a, b in zip(off, off[1:])] == texts


def test_kneser_ney_words(spark):
    """Words of any script are known as words: known sentences score better than random letters in words of the same lengths."""
    rng = random.Random(2)
    russian, english = ("в начале было слово и слово это было не последним среди многих других слов которые мы знаем".split(),
                        "in the beginning was a word and that word was not the last of many other words we know".split())
    say = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    noise = lambda text, low, n: "".join(x if x == " " else chr(low + rng.randrange(n)) for x in text)
    rows = [(i, say(russian if i % 2 else english, 60), "ru" if i % 2 else "en") for i in range(240)]
    tests = [(1000 + i, say(russian, 60), "ru") for i in range(5)]
    rows += tests + [(i + 100, noise(t, 0x430, 32), "ru") for i, t, _ in tests] + [(1200 + i, noise(say(english, 60), 97, 26), "en") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in kn_quality.judge(docs, spark.createDataFrame([(i, 1) for i in range(240)], "doc_id long, quality int")).collect()}
    seen = [(got[1000 + i].perplexity, got[1100 + i].perplexity, got[1100 + i].kept, got[1200 + i].kept) for i in range(5)]
    assert all(noisy > 1.2 * known and not r and not e for known, noisy, r, e in seen), seen
    assert sum(got[i].kept for i in range(240)) > 220


def test_url_filter(spark):
    urls = ["http://A.Example.org/es/1", "https://example.org/en/15?x=://y", "http://x.org", "http://x.org/a#b", "http://foo.com/fr/a/b?c", "http://foo.com/de/", "http://com/fr/x",
            "http://notorg/", "no scheme", "", None, "http://a.net/fr/1", "http://a.net/de/1", "://h/p", "http://x.org/a#b", "http://é.net/" + "z" * 3000]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)] + [(14, urls[14], "h", "r"), (None, None, None, None)], "page_id long, url string, host string, rule string")
    got = url_filter.judge(pages)
    assert got.count() == len(urls) + 2 and url_filter.judge(pages.limit(0)).count() == 0
    by = {r.page_id: r for r in got.collect()}
    rules = [by[i].rule for i in range(len(urls))]
    assert rules == ["example.org/es/", "example.org/en/1", None, "org/", "com/fr/", "com/de/", "com/fr/", None, None, None, None, None, None, None, "org/", None]
    assert [by[i].verdict for i in (0, 1, 3, 4, 5, 6)] == ["block", "block", "allow", "allow", "block", "allow"]
    assert (by[0].host, by[0].path, by[1].path, by[4].path, by[2].path, by[8].host, by[13].host, by[13].path) == ("a.example.org", "/es/1", "/en/15", "/fr/a/b", "", "", "h", "/p")
    assert {r.verdict for r in got.collect()} <= {"allow", "block"}


def test_license_scan(spark, odd):
    rows = [(1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/c/code.py", "x = 1\n" * 50), (3, "a/b/own.py", "# Licensed under the Apache License, Version 2.0.\n" + "y = 2\n" * 50),
            (4, "z/code.py", "nothing"), (5, None, "Released under the MIT License."), (6, "a/b/c/COPYING", "This work is licensed under the GNU General Public License, version 3."),
            (7, "a/b/c/d/e.py", None), (8, "a/x.py", ""), (8, "a/x.py", ""), (None, "ab/y.py", "z"), (9, "a/long.py", "w " * 50_000 + "\nLicensed under CC BY-NC 4.0.")]
    got = [(r.doc_id, r.licence, r.origin, r.from_dir) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, path string, text string"), "doc_id", "path", "text").collect()]
    assert sorted(got, key=str) == sorted([
        (1, "MIT", "own", None), (2, "GPL-3.0", "inherited", "a/b/c"), (3, "Apache-2.0", "own", None), (4, None, None, None), (5, "MIT", "own", None),
        (6, "GPL-3.0", "own", None), (7, "GPL-3.0", "inherited", "a/b/c"), (8, "MIT", "inherited", "a"), (8, "MIT", "inherited", "a"), (None, None, None, None),
        (9, "CC-BY-NC-4.0", "own", None)], key=str)
    assert license_scan.scan_documents(odd).count() == len(TEXTS) + 3 and license_scan.scan_documents(empty(spark)).count() == 0


GPL2 = """# This program is free software; you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation; either version 2 of the License, or
# (at your option) any later version.
x = 1
"""
BSD = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n"


@pytest.mark.parametrize("text, licence", [
    ("SPDX-License-Identifier: Apache-2.0", "Apache-2.0"), ("// SPDX-License-Identifier: GPL-3.0-only", "GPL-3.0"), ("SPDX-License-Identifier: BSD-3-Clause", "BSD-3-Clause"),
    ("SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0"), ("SPDX-License-Identifier: EUPL-1.2", None), ("GNU General Public License, version 2", "GPL-2.0"),
    ("GNU Affero General Public License, version 3", "AGPL-3.0"), ("GNU Lesser General Public License v2.1", "LGPL-2.1"), ("BSD 2-Clause License", "BSD-2-Clause"),
    ("Mozilla Public License 1.1", "MPL-1.1"), ("Mozilla Public License 1.0", None), ("Licensed under CC BY-ND 4.0.", "CC-BY-ND-4.0"), ("Licensed under CC BY-ND 3.0.", None),
    ("Licensed under GPLv3", "GPL-3.0"), (GPL2, "GPL-2.0"), (BSD, "BSD-2-Clause"),
    (BSD + "\nNeither the name of the copyright holder nor the names of its contributors\nmay be used to endorse or promote products derived from this software", "BSD-3-Clause"),
    ("a = 1\n# Licensed under the Apache License,\n# Version 2.0 (the License)\nb = 2", "Apache-2.0"), ("Copyright 2020 Somebody", None), ("the license of this is unclear", None),
    ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted", "ISC"), ("© all rights reserved", None)])
def test_license_statements(spark, text, licence):
    row = license_scan.scan(spark.createDataFrame([(1, "a.py", text)], "doc_id long, path string, text string"), "doc_id", "path", "text").first()
    assert row.licence == licence


def test_license_cosines(spark):
    """The cosines, computed again over dictionaries."""
    import math
    import re
    from collections import Counter

    def terms(text):
        text = re.sub(r"(?<![a-z])v\.? ?(?=[0-9])|(?<=gpl)v(?=[0-9])", " ", text.lower())
        return re.findall(r"[a-z0-9]+(?:\.[a-z0-9]+)*", re.sub(r"([0-9])\.0(?![0-9.]*[0-9])", r"\1", text))

    lines = ["Licensed under the Apache License, Version 2.0 and some other words", "This work is licensed under the GNU General Public License, version 3.", "the MIT license or not",
             "SPDX-License-Identifier: MPL-2.0", "license license mit mit mit"]
    templ = [(lic, Counter(terms(t))) for lic, t in license_scan.TEMPLATES]
    n = len(templ)
    held = Counter(x for _, t in templ for x in t)
    idf = {x: math.log((n + 1) / c) / math.log(n + 1) for x, c in held.items()}

    def vector(counts, outside):
        return {x: (1 + math.log(c)) * idf[x] if x in idf else outside for x, c in counts.items()}

    frame = spark.createDataFrame(list(enumerate(lines)), "file int, text string")
    for r in license_scan.similarities(license_scan.headers(frame), license_scan.templates(spark)).where("line % 4 = 1 and line > 0").collect():
        h = vector(Counter(terms(lines[r.file])), 0.25)
        best = max(sum(h.get(x, 0) * w for x, w in v.items()) / math.sqrt(sum(w * w for w in v.values())) for lic, t in templ if lic == r.licence for v in [vector(t, None)])
        assert r.cosine == pytest.approx(best / math.sqrt(sum(w * w for w in h.values())), abs=2e-6)


def test_pipeline(spark, docs, bench, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = {r.doc_id for r in quality_rules.verdicts(docs).where("kept").collect()}
    rows = [(i, t) for i, t in enumerate(TEXTS) if i in kept]
    comp = {d: c for d, _, c in brute.jaccard_components(rows)}
    rows = [(i, t) for i, t in rows if comp[i] == i]
    masks = brute.removed_mask([(i, t.encode()) for i, t in rows])
    cut = [(i, bytes(b for b, m in zip(t.encode(), masks[i]) if not m).decode("utf-8", "ignore")) for i, t in rows if not all(masks[i])]
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    items = [(r.item_id, r.text) for r in bench.collect()]
    for d, words, hit, _ in brute.contamination(cut, items):
        assert (d in got) == (hit <= 0.5 * words)
        if not hit:
            assert got[d].decoded_sha256 == hashlib.sha256(dict(cut)[d].encode()).hexdigest() and got[d].n_chars == len(dict(cut)[d])
    assert set(got) <= {i for i, _ in cut}


def test_pipeline_clashing_columns_and_empty_tables(spark, docs, bench, tmp_path):
    """Columns named like those of the last stage are replaced, others carried on; every stage takes an empty table."""
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    clash = docs.where("doc_id < 6").withColumns({c: F.lit("x") for c in ("n_tokens", "IDS", "ids_sha256", "decoded_sha256", "nth", "key", "g")})
    got = corpus_pipeline.tokens(spark, clash, str(tmp_path))
    assert sorted(c for c in got.columns if c.lower() in corpus_pipeline.MADE) == sorted(corpus_pipeline.MADE)
    assert {r.n_words for r in got.collect()} == {0} and {"nth", "key", "g"} <= set(got.columns)
    assert {r.doc_id: r.n_tokens for r in got.collect()} == {i: len(t.ids) for i, t in enumerate(_encoder().encode_batch(TEXTS[:6], add_special_tokens=False))}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.limit(0), str(tmp_path))
        assert out.columns == docs.columns and out.count() == 0, name
    assert corpus_pipeline.tokens(spark, docs.limit(0), str(tmp_path)).count() == 0


def _encoder():
    import public_tokenizers
    import tokenizers
    return tokenizers.Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
