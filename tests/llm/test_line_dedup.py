import random

import pytest

from rayloom.llm.line_dedup import dedup_lines


def slow(rows):
    """Documents as (id, text): the cleaned text of each distinct row."""
    docs = sorted({(r[0], r[1]) for r in rows if r[1] is not None}, key=lambda r: (r[0] is None, r[0] or 0))
    places, covered = {}, {}
    for doc in docs:
        lines = doc[1].split("\n")
        for i in range(len(lines) - 2):
            window = tuple(x.strip(" ") for x in lines[i : i + 3])
            if any(window):
                if window in places:
                    covered.setdefault(doc, set()).update((i, i + 1, i + 2))
                places.setdefault(window, (doc, i))
    out = []
    for i, text, *_ in rows:
        if text is None:
            out.append((i, None, 0, 0))
            continue
        lines, gone = text.split("\n"), covered.get((i, text), set())
        out.append((i, "\n".join(x for j, x in enumerate(lines) if j not in gone), len(lines), len(gone)))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in dedup_lines(df).select("doc_id", "clean_text", "n_lines", "n_removed").collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(documents, seed):
    rng = random.Random(seed)
    rows = [(i, "\n".join(rng.choice(["a", "b", " a", "c ", "", "d"]) for _ in range(rng.randint(0, 14)))) for i in range(60)]
    assert found(documents(rows)) == slow(rows)


def test_passage_shared_by_all(documents):
    passage = "first line\nsecond line\nthird line\nfourth line"
    rows = [(i, f"own {i}\n{passage}\nend {i}") for i in range(200)]
    assert found(documents(rows)) == slow(rows)
    assert sum(r[3] for r in found(documents(rows))) == 199 * 4


def test_runs_of_one_line(documents):
    rows = [(1, "x\n" * 9 + "y"), (2, "x\nx\nx")]
    assert found(documents(rows)) == slow(rows)


def test_odd_rows(odd, no_documents):
    from .conftest import ODD

    assert found(odd) == slow(ODD)
    assert found(no_documents) == []
