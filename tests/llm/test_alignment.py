"""Token alignment against a plain version: groups, links, counts over the corpus, with and without pairs left to the join."""
import hashlib
import json
from collections import Counter, defaultdict

import pytest
import sentencepiece
from tokenizers import Tokenizer

from recoflow.llm import token_alignment
from recoflow.llm.bpe import byte_symbols, tokenizer_path

SCHEMA = "doc_id long, text string, row long, id long, pairs string, n_a string"
TEXTS = ["The quick brown fox", "The quick brown fox", None, "", " ", "  two  spaces ", "tab\tand\nnew lines\n\n end", "größe ŁÓDŹ é", "日本語の文章 です 。", "🙂🙂 emoji🙂",
         "a▁b mark", "no break space x  y", "<|endoftext|> and <s> </s> <0x41> <unk>", "x" * 3000, "ab" * 4000, "!?" * 500, "it's we're ' s  's", "word " * 400,
         "mixed naïve café über 12345 3.14159 $%&", "ünï" * 700, "antidisestablishmentarianism " * 30 + "tion", "\u0085   x 　y", "end ", "\x00 nul \x7f", "ﬁ ligature", "a" * 50 + " " * 70 + "b"]


def plain(texts):
    """Rows of the contract, each text by itself and every pair of occurrences listed."""
    path = tokenizer_path("byte_bpe_50k.json")
    a, symbols = Tokenizer.from_file(path), byte_symbols()
    a.encode_special_tokens = True
    vocab = {i: bytes(symbols[c] for c in t) for t, i in json.load(open(path))["model"]["vocab"].items() if all(c in symbols for c in t)}
    b = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))

    def bytes_b(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    made = []
    for text in texts:
        x, y = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        want = (" " + text).encode() if text else b""
        if b"".join(vocab[i] for i in x) != want or b"".join(map(bytes_b, y)) != want:
            x, y = [], []
        ends = [[], []]
        for k, parts in enumerate(([vocab[i] for i in x], [bytes_b(i) for i in y])):
            n = 0
            for p in parts:
                n += len(p)
                ends[k].append(n)
        common = sorted(set(ends[0]) & set(ends[1]))
        groups, lo = [], 0
        for hi in common:
            groups.append(([i for i, e in zip(x, ends[0]) if lo < e <= hi], [j for j, e in zip(y, ends[1]) if lo < e <= hi]))
            lo = hi
        links = Counter()
        for ga, gb in groups:
            ca, cb = Counter(ga), Counter(gb)
            for i in ca:
                for j in cb:
                    links[i, j] += ca[i] * cb[j]
        made.append((x, y, groups, links))
    held = Counter(p for _, _, _, links in made for p in links)
    best = defaultdict(int)
    for (i, _), n in held.items():
        best[i] = max(best[i], n)
    for x, y, groups, links in made:
        written = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        yield (len(x), len(y), len(groups), sum(links.values()), sum(n for p, n in links.items() if held[p] == best[p[0]]),
               sum(n * held[p] for p, n in links.items()), hashlib.sha256(written.encode()).hexdigest() if x else "")


def key(r):
    return (r[0] is not None, r)


@pytest.mark.parametrize("hot, cache, wide", [(1 << 18, 200_000, 4096), (5, 50, 3), (0, 0, 0)])
def test_alignment(spark, monkeypatch, hot, cache, wide):
    monkeypatch.setattr(token_alignment, "CACHE", cache)
    monkeypatch.setattr(token_alignment, "WIDE", wide)
    token_alignment.shared_aligner.cache_clear()
    rows = [(None if i == 3 else i if i != 7 else 5, t) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame([(d, t, 1, 2, "x", "y") for d, t in rows], SCHEMA).repartition(3)
    got = [tuple(r) for r in token_alignment.align_documents(docs, hot_pairs=hot).collect()]
    want = [(d, *r) for (d, _), r in zip(rows, plain([t for _, t in rows]))]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_alignment_in_one_process(monkeypatch):
    """The plain version on the aligner itself, where caps can be set: small caches, groups counted by distinct ids."""
    import numpy as np
    import pyarrow as pa

    from recoflow.llm import textkit as tk
    monkeypatch.setattr(token_alignment, "CACHE", 7)
    monkeypatch.setattr(token_alignment, "WIDE", 2)
    aligner = token_alignment.Aligner(tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    numbers, texts, row, pairs, links = aligner.piece(*tk.utf8(pa.array(TEXTS)))
    for i, (n_a, n_b, n_groups, n_links, _, _, digest) in enumerate(plain(TEXTS)):
        assert tuple(numbers[i]) == (n_a, n_b, n_groups, n_links)
        assert (hashlib.sha256(texts[i][:-1]).hexdigest() if texts[i] else "") == digest
        assert int(links[row == i].sum()) == n_links and len(np.unique(pairs[row == i])) == int((row == i).sum())


def test_alignment_of_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert token_alignment.align_documents(empty).collect() == []
    nothing = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert [tuple(r) for r in token_alignment.align_documents(nothing).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_alignment_of_documents():
    """Given documents, encoded joined and by the library."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from recoflow.llm import textkit as tk
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column(0).to_pylist()
    numbers, made, *_ = token_alignment.shared_aligner(tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")).piece(*tk.utf8(pa.array(texts)))
    for row, text, want in zip(numbers, made, plain(texts)):
        assert tuple(row) == want[:4] and (hashlib.sha256(text[:-1]).hexdigest() if text else "") == want[6]
