import random

import pytest

from rayloom.llm.license_scan import GAP, TEMPLATES, bigrams_of, fewest, scan_licenses, seeds_of


def grams_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = "".join(c if c in "0123456789abcdefghijklmnopqrstuvwxyz" or ord(c) >= 128 else " " for c in lower).split(" ")
    words = [w for w in words if w]
    return list(zip(words, words[1:]))


def slow(text, templates, threshold):
    """Every template against every text, with no index, seeds or bounds."""
    grams, scores = grams_of(text), {}
    for name, body in templates.items():
        known = set(bigrams_of(body))
        at = [i for i, g in enumerate(grams) if g in known]
        for reach in (1, 1 + min(GAP, len(known) // 4)):
            runs = []
            for i in at:
                if runs and i - runs[-1][-1] <= reach:
                    runs[-1].append(i)
                else:
                    runs.append([i])
            for run in runs:
                common = len({grams[i] for i in run})
                passage = run[-1] - run[0] + 1 - len(run) + common
                scores[name] = max(scores.get(name, 0), 2 * common / (passage + len(known)))
    hits = sorted((-d, -len(bigrams_of(templates[n])), n) for n, d in scores.items() if d >= threshold)
    return len(hits), hits[0][2] if hits else None, -hits[0][0] if hits else None


def found(df, *args):
    return [tuple(r)[1:] for r in sorted(scan_licenses(df, *args).collect(), key=lambda r: (r.doc_id is None, r.doc_id))]


def wrapped(text, width, mark=""):
    words = text.split()
    return "\n".join(mark + " ".join(words[i : i + width]) for i in range(0, len(words), width))


@pytest.mark.parametrize("threshold", [0.8, 0.5, 1.0])
def test_equals_brute_force(documents, threshold):
    rng = random.Random(5)
    texts = [*TEMPLATES.values(), *(f"a line\n{t.upper()}\nmore" for t in TEMPLATES.values()), *(wrapped(t, 7, " * ") for t in TEMPLATES.values())]
    texts += [t.replace("License", "Licence") for t in TEMPLATES.values()] + [f"of the {t} and the rest of it in the" for t in TEMPLATES.values()]
    for t in TEMPLATES.values():
        words = t.split()
        for _ in range(len(words) // 15 + 1):
            words[rng.randrange(len(words))] = rng.choice(["the", "changed", ""])
        texts.append(" ".join(words))
    texts += ["\n".join(TEMPLATES.values()), "one", "two words", "the the the the the the", "a\n\nb\n", "MIT License released under the", TEMPLATES["MIT"] * 3]
    rows = list(enumerate(texts))
    assert found(documents(rows), TEMPLATES, threshold) == [slow(t, TEMPLATES, threshold) for t in texts]


@pytest.mark.parametrize("name", sorted(TEMPLATES))
def test_a_wrapped_notice_inside_a_text_is_found(documents, name):
    prose = "some words of a text that has nothing to do with any of it "
    texts = [f"{prose}\n\n{wrapped(TEMPLATES[name], 6, '# ')}\n\n{prose}", prose + TEMPLATES[name] + " " + prose, prose]
    got = found(documents(list(enumerate(texts))))
    assert [g[1] for g in got] == [name, name, None] and min(got[0][2], got[1][2]) >= 0.8


def test_every_passage_above_the_threshold_has_a_seed():
    rng = random.Random(2)
    sets = {n: bigrams_of(t) for n, t in TEMPLATES.items()}
    for threshold in (0.5, 0.8, 1.0):
        seeds = seeds_of(sets, threshold)
        for grams in sets.values():
            need = fewest(len(grams), threshold)
            assert 2 * (need - 1) / (need - 1 + len(grams)) < threshold
            worst = sorted(grams, key=lambda g: g in seeds)[:need]
            assert any(g in seeds for g in worst) and all(any(g in seeds for g in rng.sample(grams, need)) for _ in range(20))


def test_odd_rows(odd, no_documents):
    from .conftest import ODD

    assert sorted(found(odd), key=repr) == sorted((slow(r[1], TEMPLATES, 0.8) for r in ODD), key=repr)
    assert found(no_documents) == []


def test_repeated_rows_and_ids(documents):
    text = TEMPLATES["MIT text"]
    rows = [(1, text), (1, text), (None, text), (None, None), (2, "plain"), (2, text)]
    got = sorted(((r.doc_id, r.license) for r in scan_licenses(documents(rows)).collect()), key=repr)
    assert got == sorted([(1, "MIT text"), (1, "MIT text"), (None, "MIT text"), (None, None), (2, None), (2, "MIT text")], key=repr)


def test_many_templates(documents):
    """600 templates, of which several share passages and some are alike."""
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)]
    shared = [" ".join(rng.choices(vocabulary, k=6)) for _ in range(20)]
    templates = {f"licence {i:03}": " ".join([*rng.choices(vocabulary, k=rng.randint(4, 20)), rng.choice(shared), *rng.choices(vocabulary, k=rng.randint(0, 10))]) for i in range(590)}
    templates |= {f"licence {i:03} again": templates[f"licence {i:03}"] for i in range(10)}
    texts = []
    for name in rng.sample(sorted(templates), 60):
        words = templates[name].split()
        if rng.random() < 0.5:
            words[rng.randrange(len(words))] = "other"
        texts.append(" ".join([*rng.choices(vocabulary, k=30), *words, *rng.choices(vocabulary, k=30)]))
    texts += shared + [" ".join(rng.choices(vocabulary, k=200)) for _ in range(20)]
    got = found(documents(list(enumerate(texts))), templates, 0.8)
    assert got == [slow(t, templates, 0.8) for t in texts] and sum(g[0] > 0 for g in got) > 40 and max(g[0] for g in got) > 1


def test_no_templates(documents):
    assert found(documents([(1, "Released under the MIT License.")]), {}) == [(0, None, None)]
