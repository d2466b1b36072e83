"""Word, hash and statistics helpers against plain Python."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from wardlight.llm import bytebpe, packing, queries, quality_rules
from wardlight.llm import textbytes as tb

TEXTS = [
    "a b  c\na b\n\n a b c a b c\n",
    None,
    "",
    " \t\n",
    "é#à ü|x é#à ü|x é#à",
    "\x0b1\x0c2\r3",
    "same line\nother\nsame line\nsame line \n \n \n",
    "w" * 5000 + " " + "é" * 3000,
    "one",
]


def column(texts):
    return tb.text_bytes(pa.array(texts, pa.string()))


def test_words_and_counts_match_brute_force():
    got = [x.to_pylist() for x in quality_rules.count_statistics(*column(TEXTS))]
    for k, text in enumerate(TEXTS):
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        twice = {i + d for i, t in enumerate(triples) if triples.count(t) > 1 for d in range(3)}
        want = (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(twice))
        assert tuple(x[k] for x in got) == want


def test_equal_words_hash_alike_wherever_they_stand():
    data, offsets = column(["ab cd", "xx ab", "cd ab"])
    starts, ends = tb.runs(~tb.IS_SPACE[data], offsets)
    h = tb.Hasher(data).ranges(starts, ends)
    assert h[0] == h[3] == h[5] and h[1] == h[4] and len(set(h.tolist())) == 3


def test_slices_keep_all_rows():
    batch = pa.RecordBatch.from_pydict({"text": ["x" * n for n in (0, 10, 500, 3, 0, 700)] + [None]})
    parts = list(tb.slices(iter([batch]), "text", 100))
    assert pa.Table.from_batches(parts).to_pydict() == pa.Table.from_batches([batch]).to_pydict()


@pytest.fixture(scope="module")
def vocabulary():
    public = pytest.importorskip("public_tokenizers")
    return public, bytebpe.read_ranks(public.path("byte_bpe_50k.tiktoken"))


def odd_texts():
    rng = random.Random(1)
    alphabet = "ab cAé中 \n\t12's😀--=="
    drawn = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 200))) for _ in range(100)]
    return drawn + ["", "a" * 20_000, "ab" * 5000, " " * 3000, "".join(rng.choice("abcdefgh") for _ in range(9000))]


def test_byte_bpe_equals_the_library(vocabulary):
    tiktoken = pytest.importorskip("tiktoken")
    public, ranks = vocabulary
    library = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoder, tokens = bytebpe.Encoder(ranks, public.PATTERN), bytebpe.token_list(ranks)
    for text in odd_texts():
        ids = encoder.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert bytebpe.decode(ids, tokens) == text.encode()


def test_word_tokens_equal_the_library(vocabulary):
    from tokenizers import Tokenizer

    definition = queries.word_tokenizer()
    own, library = packing.WordTokens(definition, 2), Tokenizer.from_str(definition)
    special = "It's <|endoftext|> a<|endoftext|>b ÄÖ.,! naïve'll I'M ª ÿ Ÿ ẞ ß µm x² é É. 12a «q»  x ΣΑΣ ... <|StartOfText|>"
    for text in [*odd_texts(), special]:
        assert own.encode(text.encode()).tolist() == library.encode(text, add_special_tokens=False).ids + [2]


def test_rank_file_size_is_checked(vocabulary):
    public, _ = vocabulary
    with pytest.raises(ValueError):
        bytebpe.read_ranks(public.path("byte_bpe_50k.tiktoken"), limit=1000)


def check_packed(items, limits, pieces):
    """Every token once, in order, gapless; all limits kept; no sequence needs padding."""
    rows = [p for p in pieces]
    by_key, by_sequence = {}, {}
    for key, start, length, ids, loss, size, sequence, offset, total in rows:
        by_key.setdefault(key, []).append((start, length, np.frombuffer(ids, "<u4")))
        by_sequence.setdefault(sequence, []).append((offset, length, loss, total))
    assert set(by_key) == set(items)
    for key, (ids, _) in items.items():
        parts = sorted(by_key[key], key=lambda x: x[0])
        assert np.concatenate([p[2] for p in parts]).tolist() == ids.tolist()
        assert [p[0] for p in parts] == np.cumsum([0, *[p[1] for p in parts]])[:-1].tolist()
    for parts in by_sequence.values():
        parts.sort()
        total = sum(p[1] for p in parts)
        assert [p[0] for p in parts] == np.cumsum([0, *[p[1] for p in parts]])[:-1].tolist()
        assert total <= limits.tokens and len(parts) <= limits.segments and sum(p[2] for p in parts) <= limits.loss_tokens
        assert (total == limits.tokens or total & (total - 1) == 0) and {p[3] for p in parts} == {total}


@pytest.mark.parametrize("seed", range(6))
def test_packer_keeps_all_limits(seed):
    rng = np.random.default_rng(seed)
    limits = packing.Limits(tokens=64, segments=int(rng.integers(1, 6)), loss_tokens=int(rng.integers(5, 64)), pool=8)
    items = {}
    for k in range(120):
        size = int(rng.choice([1, 2, 5, 30, 64, 65, 300]))
        items[k] = (np.arange(size, dtype=np.uint32) + k, None if k % 3 else rng.random(size) < 0.4)
    packer, out = packing.Packer(limits, 0), []
    for key, (ids, loss) in items.items():
        out += packer.add(key, ids, loss)
    out += packer.finish()
    check_packed(items, limits, out)


def test_packer_refuses_empty_limits():
    with pytest.raises(ValueError):
        packing.Packer(packing.Limits(segments=0), 0)
