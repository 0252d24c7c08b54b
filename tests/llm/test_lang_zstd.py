import random
import unicodedata

import xxhash
import zstandard
from pyspark.sql import functions as F

from rayloom.llm import lang_zstd as lz
from rayloom.llm.common import id_fold

SYLLABLES = {"en": "th er ing on tion and the est ly".split(), "de": "sch ung ein ver keit ü ß ich pf".split(), "fr": "eau é ment ou que è oi aux re".split()}


def corpus(n):
    rng = random.Random(6)
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "en", "de", "fr"])
        text = " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(8, 400)))
        rows.append((i, text, lang, "s"))
    return rows


def test_held_out_accuracy(spark, documents):
    docs = documents(corpus(600))
    contents = lz.dictionaries(docs, ~id_fold("doc_id", 3, 1))
    assert [x[0] for x in contents][0] == "en" and all(len(x[1]) <= 100_000 for x in contents)
    found = {r.doc_id: r for r in lz.identify(docs, contents).collect()}
    held = [r for r in docs.filter(id_fold("doc_id", 3, 1)).collect()]
    assert len(held) > 100
    assert sum(found[r.doc_id].lang_pred == r.lang for r in held) / len(held) > 0.98
    assert lz.dictionaries(docs.repartition(5), ~id_fold("doc_id", 3, 1)) == contents


def test_odd_rows(spark, odd, no_documents, documents):
    contents = lz.dictionaries(documents(corpus(100)), ~id_fold("doc_id", 3, 1))
    found = {r.doc_id: r for r in lz.identify(odd, contents).collect()}
    assert {i for i, r in found.items() if r.lang_pred == "und"} >= {0, 1, 2}
    assert all(0 <= r.score <= 1 for r in found.values()) and found[0].score == 0
    assert found[3].lang_pred in SYLLABLES and found[6].lang_pred in SYLLABLES
    assert lz.identify(no_documents, contents).count() == 0
    assert lz.dictionaries(no_documents, ~id_fold("doc_id", 3, 1)) == []


def test_numbers_that_are_word_characters_are_no_letters(documents):
    assert lz.letters_of("² ½ Ⅷ ৩ ٤ _ 7") == b"" and lz.letters_of("A²b½ Éß") == "a b éß".encode()
    rows = lz.identify(documents([(1, "² ½"), (2, "x²")]), [("en", b"some letters here"), ("fr", b"quelques lettres")]).orderBy("doc_id").collect()
    assert rows[0].lang_pred == "und" and rows[0].score == 0 and rows[1].lang_pred in ("en", "fr")


def slow_letters(text):
    """Character by character: letters, and marks behind a letter or another mark that is kept."""
    out = []
    for c in (text or "").lower():
        kind = unicodedata.category(c)[0]
        out.append(c if kind == "L" or kind == "M" and out and out[-1] != " " else " ")
    return " ".join("".join(out).split(" ")).split()


def slow_dictionaries(rows, sample_docs, piece_chars, size):
    """Every document of a language in the order of its hash, cut one by one."""
    found = {}
    for i, text, lang, *_ in rows:
        if None not in (i, text, lang):
            seed = xxhash.xxh64_intdigest(i.to_bytes(8, "little"), xxhash.xxh64_intdigest(b"zstd", 42))
            place = xxhash.xxh64_intdigest(text.encode(), seed)
            found.setdefault(lang, []).append((place - 2**64 if place >= 2**63 else place, text))
    out = []
    for lang, own in sorted(found.items(), key=lambda x: (-len(x[1]), x[0])):
        pieces = []
        for _, text in sorted(set(own))[:sample_docs]:
            letters = " ".join(slow_letters(text))
            at = max(0, (len(letters) - piece_chars) // 2)
            pieces.append(letters[at : at + piece_chars])
        if content := " ".join(p for p in pieces if p).encode()[:size]:
            out.append((lang, content))
    return out


def test_dictionaries_equal_plain_cutting(documents):
    rows = corpus(300) + [(1000 + i, "हिन्दी भाषा " * (i % 7), "hi", "s") for i in range(30)] + [(5, None, "en", "s"), (None, "text", "en", "s"), (6, "12", "xx", "s")] + corpus(20)
    assert lz.dictionaries(documents(rows), F.lit(True), sample_docs=40, piece_chars=100, dictionary_bytes=3000) == slow_dictionaries(rows, 40, 100, 3000)


def test_marks_stay_on_their_letters(documents):
    assert lz.letters_of("हिन्दी भाषा, \u0301x e\u0301!").decode() == "हिन्दी भाषा x e\u0301" and lz.letters_of("\u0301 \u093f") == b""
    texts = ["हिन्दी भाषा", "a\u0301b ½ \u0301 ²x", "Éß ⅷ_q٣"]
    assert [lz.letters_of(t).decode() for t in texts] == [" ".join(slow_letters(t)) for t in texts]


def test_three_hundred_languages(documents):
    """None is left out, whatever the number; together the dictionaries stay within their bound."""
    rng, rows = random.Random(3), []
    for lang in range(300):
        words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(30)]
        rows += [(lang * 10 + k, " ".join(rng.choices(words, k=60)), f"l{lang:03}", "s") for k in range(3)]
    contents = lz.dictionaries(documents(rows), F.lit(True), total_bytes=240_000)
    assert len(contents) == 300 and sum(len(c) for _, c in contents) <= 240_000
    some = rows[::45]
    found = {r.doc_id: r.lang_pred for r in lz.identify(documents(some), contents).collect()}
    assert sum(found[i] == lang for i, _, lang, _ in some) / len(some) > 0.95


def slow_prediction(text, contents, level=5):
    """One plain zstandard call for each language and piece, with nothing shared between texts."""
    letters = " ".join(slow_letters(text)).encode()
    if not letters:
        return "und"
    sizes = []
    for lang, content in contents:
        known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        packer = lambda: zstandard.ZstdCompressor(level=level, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False)
        sizes.append(sum(len(packer().compress(letters[i : i + lz.PIECE])) for i in range(0, len(letters), lz.PIECE)))
    return contents[sizes.index(min(sizes))][0]


def test_equals_one_call_per_language(documents):
    rows = corpus(120)
    contents = lz.dictionaries(documents(rows), ~id_fold("doc_id", 3, 1))
    got = {r.doc_id: r.lang_pred for r in lz.identify(documents(rows), contents).collect()}
    assert got == {i: slow_prediction(t, contents) for i, t, *_ in rows}


def test_the_sample_is_bounded_by_languages_pieces_and_rows(spark, documents):
    rows = [(1, "one text that is there very often", "en", "s")] * 3000 + [(i, f"text number {i} of many in this language", "en", "s") for i in range(2, 900)]
    rows += [(10_000 + i, "rare words", f"l{i:03}", "s") for i in range(40)]
    docs = documents(rows)
    contents = lz.dictionaries(docs, F.lit(True), sample_docs=50)
    assert len(contents) == 41 and contents[0][0] == "en"
    pieces = contents[0][1].decode().split("text number")
    assert contents[0][1].count(b"one text that is there") <= 1 and len(pieces) - 1 in (49, 50)


def test_no_language_and_one_language(documents, odd):
    assert {r.lang_pred for r in lz.identify(odd, []).collect()} == {"und"}
    row = lz.identify(documents([(1, "some letters"), (2, "123 !?")]), [("en", b"some letters here")]).orderBy("doc_id").collect()
    assert [(r.lang_pred, r.score) for r in row] == [("en", 1.0), ("und", 0.0)]


def test_narrow_margins_are_rejected():
    encoder = lz.Encoder([("a", b"the quick brown fox " * 20), ("b", b"the quick brown fox " * 20)], 3)
    lang, score, margin = encoder.judge("the quick brown fox")
    assert lang == "a" and score == margin == 0
