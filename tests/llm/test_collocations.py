import random
import re
from collections import Counter
from decimal import Decimal

import pytest

from rayloom.llm import collocations as co


def brute(rows, max_words=3, min_count=10, covered=50, top=2000):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in range(1, max_words + 1) for i in range(len(words) - k + 1))
    candidates = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= min_count}
    out = []
    for (lang, w), a in candidates.items():
        longer = [b for (x, v), b in candidates.items() if x == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v)))]
        if any(100 * b >= covered * a for b in longer):
            continue
        cut = min((1000000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        out.append((lang, -cut[0], -a, " ".join(w).encode(), f[lang, w[: cut[1]]], f[lang, w[cut[1] :]]))
    ranked, seen = [], Counter()
    for lang, score, a, phrase, left, right in sorted(out):
        seen[lang] += 1
        if seen[lang] <= top:
            ranked.append((lang, seen[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(ranked)


def run(documents, rows, **options):
    found = co.mine_phrases(documents(rows), **options)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in found.collect())


def corpus(n, seed):
    rng = random.Random(seed)
    words = ["New", "york", "of", "the", "a", "é", "ß-x", " ", "\x1c", "\x85", "日本"]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\r\n"]) for _ in range(rng.randint(0, 60)))
        rows.append((i, text, rng.choice(["en", "en", "fr", None, "und"])))
    return rows


@pytest.mark.parametrize("part_words, max_words, min_count", [(1_000_000, 3, 10), (7, 3, 4), (50, 4, 3), (1, 2, 2)])
def test_equals_brute_force(documents, part_words, max_words, min_count):
    rows = corpus(60, part_words)
    want = brute(rows, max_words, min_count)
    assert want and run(documents, rows, part_words=part_words, max_words=max_words, min_count=min_count) == want


def test_a_hot_phrase_ties_and_top(documents):
    rows = [(i, "one key may hold a third. b c; c b", "en") for i in range(200)] + [(i, "x y", "de") for i in range(12)]
    for top in (1, 3, 2000):
        assert run(documents, rows, top=top) == brute(rows, top=top)


def test_long_text_is_cut_between_words_only():
    """A text without any piece end, in small stretches and parts, gives the same counts as in one."""
    rng = random.Random(5)
    text = " ".join(rng.choice("ab cd efg h".split()) for _ in range(3000)).encode()
    assert b"".join(co.stretches(text, 64)) == text and len(list(co.stretches(text, 64))) > 50
    whole, parts, part = Counter(), Counter(), co.Part()
    part.add(text, True)
    whole.update(unpacked(part, {b"cd": 5}))
    part = co.Part()
    for at, stretch in enumerate(co.stretches(text, 64)):
        part.add(stretch, at == 0)
        if at % 3 == 2:
            parts.update(unpacked(part, {b"efg": 3}))
            part = part.rest(3)
    parts.update(unpacked(part, {}))
    assert parts == whole and sum(n for p, n in whole.items() if b" " not in p) == 3000


def unpacked(part, spread):
    out = {}
    for head, salt, lines in zip(*(x.to_pylist() if hasattr(x, "to_pylist") else x.tolist() for x in part.packs(3, spread))):
        assert 0 <= salt < spread.get(head, 1) and lines.endswith(b"\n")
        for line in lines[:-1].split(b"\n"):
            tail, count = line.split(b"\t")
            assert (phrase := head + b" " * bool(tail) + tail) not in out
            out[phrase] = int(count)
    return out


def test_hot_words_are_spread(documents, spark):
    """A first word that makes a third of all words is dealt to many rows; the counts stay right."""
    rng = random.Random(8)
    rows = [(i, " ".join(w for _ in range(40) for w in ("hot", f"w{rng.randint(0, 900)}", f"v{rng.randint(0, 900)}")), "en") for i in range(60)]
    texts = documents(rows).selectExpr("lang", "CAST(text AS BINARY) AS text")
    spread = co.hot_words(co.word_shares(texts, 1000))
    assert spread[b"hot"] > 600 and len(spread) <= 1000
    packs = co.phrase_packs(texts, 3, 1000, spread)
    largest = max(len(r.lines) for r in packs.filter("head = CAST('hot' AS BINARY)").collect())
    assert largest < 400
    assert run(documents, rows, min_count=2) == brute(rows, min_count=2)


def test_counts_beyond_64_bit_products_are_exact(spark):
    """Counts as of a very large corpus: a * a passes 64 bits."""
    big = 98_765_432_109
    rows = [("en", "a", 3 * big + 1), ("en", "b", 2 * big + 7), ("en", "a b", big), ("en", "b a", 10), ("en", "a b a", 10)]
    counts = spark.createDataFrame(rows, "lang string, phrase string, f long")
    got = {r.phrase: (r.l, r.r, r.score) for r in co.best_cuts(counts, 10).collect()}
    f = {p: n for _, p, n in rows}
    assert got["a b"] == (f["a"], f["b"], 1000000 * big * big // (f["a"] * f["b"]))
    assert Decimal(1000000) * big * big > 2**64 and got["a b a"] == min((f["a"], f["b a"], 1000000 * 100 // (f["a"] * 10)), (f["a b"], f["a"], 0), key=lambda x: x[2])


def test_odd_rows_and_columns(documents, odd, no_documents):
    from .conftest import ODD

    assert co.mine_phrases(no_documents).count() == 0
    rows = [r[:3] for r in ODD] * 4
    full = [(*r, *[None] * (4 - len(r))) for r in ODD] * 4
    assert sorted(tuple(r) for r in co.mine_phrases(documents(full)).collect()) == brute(rows)
