"""Language ID, near duplicates, repeated passages, licences, nearest neighbours and the pipeline,
against brute-force versions on small tables."""

import os
import random
import unicodedata
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from typeweave.llm import components, language_id, learned_ann, licence_scan, ngram_jaccard, substring_dedup
from typeweave.llm.licence_texts import LICENCES

WORDS = [a + b + c for a in ("ta", "ro", "ki", "mu") for b in ("ne", "so", "li", "va", "du") for c in ("", "n", "rt", "sk", "mp")]


def prose(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


SCRIPTS = {"HIRAGANA", "KATAKANA", "THAI", "LAO", "KHMER", "MYANMAR"}


def brute_words(text):
    """Lower-cased words; each character of a script without blanks is one."""
    out = []
    for word in text.lower().split():
        last = ""
        for c in word:
            name = unicodedata.name(c, "")
            if name.startswith("CJK UNIFIED") or name.split(" ")[0] in SCRIPTS and "PROLONGED" not in name:
                out += [last, c] if last else [c]
                last = ""
            else:
                last += c
        out += [last] if last else []
    return out


# near duplicates


def brute_groups(rows, n=5, threshold=0.8):
    """{row number: (class id, links, copies)}"""
    texts: dict = {}
    for k, (doc, text) in enumerate(rows):
        if doc is not None:
            texts.setdefault(("null", k) if text is None else text, []).append(k)
    sets = {}
    for text in texts:
        words = brute_words(text) if isinstance(text, str) else []
        m = min(n, len(words))
        sets[text] = {tuple(words[i : i + m]) for i in range(len(words) - m + 1)} if words else set()
    links = {t: set() for t in texts}
    for a, b in combinations(texts, 2):
        union = len(sets[a] | sets[b])
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * union - 1e-9:
            links[a].add(b)
            links[b].add(a)
    out = {}
    for t, own in texts.items():
        seen, waiting = {t}, [t]
        while waiting:
            for other in links[waiting.pop()] - seen:
                seen.add(other)
                waiting.append(other)
        first = min(rows[k][0] for s in seen for k in texts[s])
        out |= {k: (first, len(links[t]), len(own)) for k in own}
    return out


@pytest.fixture(scope="module")
def near_copies():
    rng = random.Random(8)
    rows, number = [], 0
    for size in (1, 1, 2, 3, 9, 70):
        original = prose(rng, 120)
        for _ in range(size):
            words = list(original)
            for _ in range(rng.randrange(0, 7)):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            rows.append((number, " ".join(words)))
            number += 1
    rows += [(number + k, t) for k, t in enumerate([rows[0][1], rows[0][1].upper(), rows[5][1].replace(" ", "\n  "), "", "", None, None, "one", "ONE", "one two", "a b c d e f", "a b c d e f", "x " * 4000])]
    rows += [rows[3], (rows[3][0], "repeated id, another text"), (None, rows[4][1])]
    for script in UNSPACED_SCRIPTS:
        original = rng.choices(script, k=300)
        for k in range(4):
            letters = list(original)
            for _ in range(3 * k):
                letters[rng.randrange(300)] = rng.choice(script)
            rows.append((number + 100, "".join(letters[:150]) + " Latin, word " + "".join(letters[150:])))
            number += 1
    return rows


#: Characters of scripts that put no blanks between words.
UNSPACED_SCRIPTS = ["".join(map(chr, range(a, a + n))) for a, n in ((0x4E00, 400), (0x3041, 80), (0x0E01, 46), (0x1780, 35), (0x20000, 300))]


@pytest.mark.parametrize("paired, block, least", [(40, 256, 64), (2, 16, 64), (2, 2048, 3)])
def test_near_duplicates(docs, near_copies, monkeypatch, paired, block, least):
    monkeypatch.setattr(ngram_jaccard, "PAIRED", paired)
    monkeypatch.setattr(ngram_jaccard, "BLOCK_TEXTS", block)
    monkeypatch.setattr(ngram_jaccard, "LEAST_TEXTS", least)
    got = ngram_jaccard.groups(docs(near_copies)).collect()
    wanted = brute_groups(near_copies)
    expected = sorted([(near_copies[k][0], *v) for k, v in wanted.items()])
    assert sorted((r.id, r.class_id, r.n_links, r.n_copies) for r in got if r.id is not None) == expected
    assert [(r.class_id, r.n_links, r.n_copies) for r in got if r.id is None] == [(None, 0, 1)]
    assert len(got) == len(near_copies)


def test_no_documents(docs):
    assert ngram_jaccard.groups(docs([])).collect() == []
    assert ngram_jaccard.groups(docs([(1, None)])).select("id", "class_id").collect() == [(1, 1)]


def test_pruning_keeps_pairs_above_the_threshold():
    rng = np.random.default_rng(4)
    left = rng.integers(0, 256, (20_000, ngram_jaccard.VALUES), dtype=np.uint8)
    for similarity, least, most in ((0.8, 0.9995, 1.0), (0.9, 1.0, 1.0), (0.5, 0.0, 0.05), (0.2, 0.0, 0.0)):
        same = rng.random(left.shape) < similarity
        right = np.where(same, left, rng.integers(0, 256, left.shape, dtype=np.uint8))
        kept = len(ngram_jaccard.surviving(left, right, 0.8)) / len(left)
        assert least <= kept <= most, (similarity, kept)
    small = slice(0, 60)
    a, b = ngram_jaccard.surviving_pairs(left[small], np.where(rng.random((60, 128)) < 0.9, left[small], 0), 0.8, same=False)
    assert set(zip(range(60), range(60))) <= set(zip(a.tolist(), b.tolist()))


def test_common_counts_of_differences_are_those_of_sets():
    rng = np.random.default_rng(1)
    pivot = np.unique(rng.integers(0, 4000, 300).astype(np.uint64))
    sets = [pivot]
    for k in range(24):
        if k % 3:
            own = np.union1d(rng.choice(pivot, len(pivot) - 5 * k, replace=False), rng.integers(0, 4000, 4 * k).astype(np.uint64))
        else:
            own = np.unique(rng.integers(0, 4000, rng.integers(1, 300)).astype(np.uint64))
        sets.append(own)
    near, keys, drops, shared = zip(*(ngram_jaccard.difference(own, pivot) for own in sets))
    assert sum(near) == 17 and len(keys[0]) == 0
    made = ngram_jaccard.Sets(np.asarray(near), list(keys), np.asarray(drops), np.asarray(list(map(len, sets))), np.asarray(shared), len(pivot))
    a, b = np.triu_indices(25, 1)
    wanted = [len(np.intersect1d(sets[i], sets[j])) for i, j in zip(a, b)]
    assert made.common(a, b).tolist() == wanted
    assert made.common(a[:30], b[:30]).tolist() == wanted[:30]
    base = made.common(a, b) - made._few(a, b)
    assert (base + made._many(a, b, width=64)).tolist() == wanted


def test_components(shipped):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)] + [(500, k) for k in range(501, 560)] + [(7, 7), (None, 3)]
    got = {r.id: r.component for r in components.components(shipped.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(k):
        while root.setdefault(k, k) != k:
            k = root[k]
        return k

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    assert got == {k: find(k) for k in root}
    assert components.components(shipped.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("few", [0, 400])
def test_components_by_rounds_and_in_one_task(shipped, monkeypatch, few):
    monkeypatch.setattr(components, "FEW", few)
    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 440)] + [(7, 7), (None, 3)]
    wanted = {k: {k} for e in edges for k in e if None not in e and e[0] != e[1]}
    for a, b in edges:
        if a in wanted and b in wanted and wanted[a] is not wanted[b]:
            wanted[a] |= wanted[b]
            wanted |= dict.fromkeys(wanted[a], wanted[a])
    rounds, star = [], components._large_star
    monkeypatch.setattr(components, "_large_star", lambda now: rounds.append(1) or star(now))
    got = components.components(shipped.createDataFrame(edges, "a long, b long").repartition(3)).collect()
    assert len(got) == len(wanted) and {r.id: r.component for r in got} == {k: min(v) for k, v in wanted.items()}
    assert bool(rounds) == (few == 0)


# repeated passages


def brute_spans(rows, n):
    """{(id, text): numbers of the words that go}"""
    seen, out = {}, {}
    for doc, text in sorted({(d, t) for d, t in rows if d is not None and t}, key=lambda r: (r[0], rows.index(r))):
        words = brute_words(text)
        for k in range(len(words) - n + 1):
            key = tuple(words[k : k + n])
            if key in seen:
                out.setdefault((doc, text), set()).update(range(k, k + n))
            else:
                seen[key] = doc
    return out


@pytest.fixture(scope="module")
def passages():
    rng = random.Random(2)
    shared = [prose(rng, n) for n in (51, 60, 75, 49, 50)]
    rows = []
    for k in range(40):
        words = prose(rng, rng.randrange(5, 200))
        for _ in range(rng.randrange(0, 3)):
            at = rng.randrange(len(words) + 1)
            words[at:at] = rng.choice(shared)
        text = " ".join(words)
        rows.append((k, text.upper() if k % 9 == 4 else text.replace(" ", "  \n", 3)))
    rows += [(50, None), (51, ""), (52, "tick tock " * 200), (53, rows[3][1]), (54, " ".join(shared[1])), (55, "13 " * 70), (56, "ab" * 30_000)]
    rows += [rows[7], (None, rows[8][1])]
    for k, script in enumerate(UNSPACED_SCRIPTS):
        shared = "".join(rng.choices(script, k=55))
        for doc in range(3):
            rows.append((100 + 3 * k + doc, "".join(rng.choices(script, k=rng.randrange(30))) + shared[: 20 + doc % 2] + " " * (doc % 2) + shared[20 + doc % 2 :] + " Latin " + "".join(rng.choices(script, k=40))))
    return rows


def test_repeated_passages(docs, passages):
    df = docs(passages)
    spans = {r.id: r.spans for r in substring_dedup.duplicate_spans(df).collect()}
    wanted = brute_spans(passages, 50)
    got = {}
    for k, own in spans.items():
        for s in own:
            assert s.words >= 50 and (s.first_id < k or s.first_id == k)
            got.setdefault(k, set()).update(range(s.first_word, s.first_word + s.words))
    assert got == {doc: words for (doc, _), words in wanted.items()}
    out = substring_dedup.dedup(df)
    assert out.columns == df.columns
    texts = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    assert len(texts) == len(passages)
    for (doc, text), (_, old) in zip(texts, sorted(passages, key=repr)):
        gone = wanted.get((doc, old), set())
        if not gone:
            assert text in [t for d, t in passages if d == doc]
    for doc, text in texts:
        olds = [t for d, t in passages if d == doc]
        assert any((text is None and t is None) or (t is not None and text is not None and brute_words(text) == [w for k, w in enumerate(brute_words(t)) if k not in wanted.get((doc, t), set())]) for t in olds)
    assert substring_dedup.dedup(docs([])).collect() == []


@pytest.mark.parametrize("letters, words", [((1, 1), 50), ((1, 2), 50), ((1, 3), 55), ((2, 4), 60), ((3, 9), 50), ((40, 90), 50), ((600, 700), 50)])
def test_no_repeated_passage_is_missed(docs, letters, words):
    rng = random.Random(words)

    def random_words(n):
        return ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(*letters))) for _ in range(n)]

    rows = []
    for k in range(150):
        shared = random_words(words)
        for doc in (2 * k, 2 * k + 1):
            rows.append((doc, " ".join(random_words(rng.randrange(0, 30)) + shared + random_words(rng.randrange(0, 30)))))
    got = {}
    for r in substring_dedup.duplicate_spans(docs(rows)).collect():
        for s in r.spans:
            got.setdefault(r.id, set()).update(range(s.first_word, s.first_word + s.words))
    assert got == {doc: gone for (doc, _), gone in brute_spans(rows, 50).items()}


def test_copies_of_texts_go_whole(docs):
    rng = random.Random(9)
    text, other, short = prose(rng, 90), prose(rng, 200), prose(rng, 49)
    rows = [(k, " ".join(text)) for k in range(100, 400)] + [(k, " ".join(w.upper() for w in text)) for k in range(400, 420)]
    rows += [(500, " ".join(other[:70] + text[:55] + other[70:])), (50, " ".join(other[:60])), (501, " ".join(short)), (502, " ".join(short)), (100, " ".join(text))]
    got, first = {}, {}
    for r in substring_dedup.duplicate_spans(docs(rows)).collect():
        for s in r.spans:
            got.setdefault(r.id, set()).update(range(s.first_word, s.first_word + s.words))
            first.setdefault(r.id, []).append((s.first_word, s.first_id))
    assert got == {doc: words for (doc, _), words in brute_spans(rows, 50).items()}
    assert all(own == [(0, 100)] for k, own in first.items() if k < 500) and sorted(first[500]) == [(0, 50), (70, 100)]
    early = [(1, " ".join(other[:20] + text)), *rows]  # an earlier text that holds the copies' words
    assert {tuple(s.first_id for s in r.spans) for r in substring_dedup.duplicate_spans(docs(early)).collect() if 100 <= r.id < 420} == {(1,)}


def test_chunks_resist_insertions():
    rng = random.Random(5)
    words = prose(rng, 3000)
    cut = []
    for text in (words, words[:900] + ["inserted"] + words[900:]):
        raw = np.frombuffer(" ".join(text).encode(), np.uint8)
        ends = substring_dedup.chunk_ends(raw)
        assert ends[-1] == len(raw) and np.diff(ends, prepend=0).max() <= substring_dedup.MAX_CHUNK and (np.diff(ends) > 0).all()
        cut.append({raw[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends)})
    assert len(cut[0] - cut[1]) <= 4


# licences


def licence_ids(rows, docs, known):
    return {(r.id, r.licence_id) for r in licence_scan.scan(docs(rows), known).collect()}


def test_licences(docs, shipped):
    mit = LICENCES["MIT"]
    rows = [
        (1, "MIT License\n\nCopyright (c) 2020 Somebody\nCopyright (c) 2021 Somebody Else\n\n" + mit),
        (2, "Copyright (c) 2020 Somebody <a@b.c>\n\n" + mit),
        (3, mit.upper().replace('"', "'").replace("\n\n", "\r\n\r\n  ") + "\n(c) 2001 X Corp."),
        (4, mit.replace("sublicense", "sub-license").replace("COPYRIGHT HOLDERS", "COPYRIGHT OWNERS")),
        (5, mit + " and more"),
        (6, None),
        (7, " ... \n"),
        (8, LICENCES["ISC"]),
        (9, "* " + LICENCES["BSD-2-Clause"].replace("1. ", "a) ").replace("2. ", "b) ")),
        (9, LICENCES["0BSD"]),
        (10, "© 2019 A. Person, all rights reserved\n" + LICENCES["Zlib"].replace("acknowledgment", "acknowledgement")),
        (11, "Copyright (c) 2020 X. All rights reserved. " + LICENCES["BSD-3-Clause"].replace("\n", " ")),
        (12, "Copyright (c) 1999 One Two " + mit.replace("\n", " ")),
        (13, "All rights reserved.\nAll rights reserved.\nAll rights reserved.\n" + mit),
        (14, "All rights reserved.\n"),
        (15, "Copyright (c) 2020 " + "a long sentence of no licence " * 200),
    ]
    known = licence_scan.known_licences(shipped)
    found = licence_scan.scan(docs(rows), known).collect()
    got = sorted(((r.id, r.licence_id, r.digest is None) for r in found), key=repr)
    ids = {1: "MIT", 2: "MIT", 3: "MIT", 4: "MIT", 8: "ISC", 10: "Zlib", 11: "BSD-3-Clause", 12: "MIT", 13: "MIT"}
    wanted = [(k, ids.get(k), k in (6, 7, 14)) for k, _ in rows if k != 9] + [(9, "0BSD", False), (9, "BSD-2-Clause", False)]
    assert got == sorted(wanted, key=repr)
    assert licence_scan.scan(docs([]), known).collect() == []
    assert {r.licence_id for r in licence_scan.scan(docs(rows), known.limit(0)).collect()} == {None}
    assert known.select("digest").distinct().count() == known.count()


def test_equal_spellings_side_by_side(docs):
    texts = ["license license x", "licence license x", "license licence x", "licence licence x", "Licence, LICENCE: x", "sub licence copyright owners", "sublicense copyright holder"]
    words = [r.w for r in docs(list(enumerate(texts))).select(licence_scan.canonical(F.col("text")).alias("w")).collect()]
    assert set(words[:5]) == {"license license x"} and set(words[5:]) == {"sublicense copyright holder"}


def test_licence_scan_needs_no_python_worker(docs, shipped):
    plan = licence_scan.scan(docs([(1, "x")]), licence_scan.known_licences(shipped))._jdf.queryExecution().executedPlan().toString()
    nodes = [line.lstrip(" :+-*()0123456789").split(" ")[0] for line in plan.splitlines()]
    assert not [n for n in nodes if "Python" in n or "Arrow" in n or "Pandas" in n]
    assert sum(n in ("Scan", "LocalTableScan") for n in nodes) <= 1 and "Range" in nodes  # the documents; the known side is made of literals


def test_digests_of_long_licences(docs, shipped):
    folder = "/usr/share/common-licenses"
    files = {"Apache-2.0": "Apache-2.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "GFDL-1.3": "GFDL-1.3"}
    if not all(os.path.exists(f"{folder}/{f}") for f in files.values()):
        pytest.skip("this system has no licence files")
    end, rows, wanted = "END OF TERMS AND CONDITIONS", [], set()
    for number, (name, file) in enumerate(files.items()):
        with open(f"{folder}/{file}") as f:
            text = f.read()
        for k, own in enumerate([text, text.split(end)[0], text.replace("\n", "\r\n").upper()]):
            rows.append((10 * number + k, own))
            wanted.add((10 * number + k, name))
    assert licence_ids(rows, docs, licence_scan.known_licences(shipped)) == wanted


# language


SAMPLES = {
    "en": "the and of with that which is was for this have from they are not but what all were when your can said there use each".split(),
    "de": "der und die das nicht mit sich auf für ist im dem den auch werden aus bei noch wie einen über so zum haben nur oder".split(),
    "fr": "le de un être et à il avoir ne je son que se qui ce dans en du elle au pour pas sur plus par ou avec tout mais".split(),
    "es": "el la de que y en un ser se no haber por con su para como estar tener le lo todo pero más hacer o poder decir este".split(),
    "xx": "zzq qqz zqz qzq wxw xwx".split(),
}


def test_languages(shipped):
    rng = random.Random(6)
    rows = [(k, " ".join(rng.choices(SAMPLES[lang], k=rng.randrange(8, 60))), lang) for k, lang in enumerate(rng.choices(list(SAMPLES), k=600))]
    rows += [(1000, None, "en"), (1001, "", None), (1002, "123 !? 456", "de"), (1003, "the and of with that " * 4000, None), (None, "der und die das nicht mit sich", "de"), (rows[0])]
    df = shipped.createDataFrame([(*r, 1.0, "x") for r in rows], "doc_id long, text string, lang string, score double, lang_pred string")
    model = language_id.train(df.where("doc_id % 3 <> 2"))
    assert [name for name, _ in model.families] == ["germanic", "romance", "xx"]
    got = {r.id: r for r in language_id.predict(df, model).collect()}
    held = [(k, lang) for k, _, lang in rows[:600] if k % 3 == 2]
    assert sum(got[k].lang_pred == lang for k, lang in held) >= 0.97 * len(held)
    for k in (1000, 1001, 1002):
        assert (got[k].lang_pred, got[k].score) == ("und", 0.0)
    assert got[1003].lang_pred == "en" and got[None].lang_pred == "de"
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = language_id.predict(df, model, keep=True).select("row.*")
    assert kept.columns == df.columns and kept.count() == len(rows)
    nothing = language_id.train(df.where("lang IS NULL"))
    assert nothing is None and {r.lang_pred for r in language_id.predict(df, nothing).collect()} == {"und"}
    assert language_id.predict(df.limit(0), model).collect() == []
    one = language_id.train(df.where("lang = 'en'"))
    assert {r.lang_pred for r in language_id.predict(df.where("doc_id < 5"), one).collect()} == {"en"}


def brute_prediction(model, text):
    """Language, score and share of known trigrams of a text, n-gram by n-gram."""
    data = b" " + bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in " ".join(text.lower().split()).encode()) + b"    "
    counts, threes = {}, {}
    bucket = lambda own: (lambda x: ((x ^ x >> 15) & 0xFFFFFFFF) >> 17)((int.from_bytes(own, "big") + len(own) * 0x51ED) * 0x9E3779B1 & 0xFFFFFFFF)
    for at in range(len(data) - 3):
        for n in (1, 2, 3, 4):
            own = data[at : at + n]
            counts[bucket(own)] = counts.get(bucket(own), 0) + 1
            if n == 3 and data[at] != 32:
                threes[bucket(own)] = threes.get(bucket(own), 0) + 1
    norm = sum(c * c for c in counts.values()) ** 0.5
    odds = [(sum(c * float(model.weights[b, k]) for b, c in counts.items()) / norm + model.biases[k]) * model.scales[k] for k in range(model.weights.shape[1])]
    chance = [1 / (1 + np.exp(-min(30, max(-30, x)))) for x in odds]
    family, part = 0, 1.0
    if len(model.families) > 1:
        own = [chance[k] for k in model.one_versus_rest]
        family = max(range(len(own)), key=lambda k: odds[model.one_versus_rest[k]])
        part = own[family] / sum(own)
    names = model.families[family][1]
    votes, margins, likely = [0] * len(names), [0.0] * len(names), [0.0] * len(names)
    for f, i, j, k in model.pairs:
        if f == family:
            votes[i if chance[k] >= 0.5 else j] += 1
            for own, sign in ((i, 1), (j, -1)):
                margins[own] += sign * odds[k]
                likely[own] += chance[k] if sign > 0 else 1 - chance[k]
    best = max(range(len(names)), key=lambda k: (votes[k], margins[k]))
    known = sum(c for b, c in threes.items() if model.known[b])
    return names[best], part * (likely[best] / (len(names) - 1) if len(names) > 1 else 1.0), (known + 8) / (sum(threes.values()) + 8)


def test_predictions_are_those_of_a_plain_version(shipped):
    rng = random.Random(12)
    langs = ["de", "en", "nl", "fr", "es", "xx"]
    words = {lang: SAMPLES.get(lang, "een het van ik je dat niet zijn op maar wat".split()) for lang in langs}
    rows = [(k, " ".join(rng.choices(words[lang], k=rng.randrange(4, 40))), lang) for k, lang in enumerate(rng.choices(langs, k=400))]
    model = language_id.train(shipped.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = [t for _, t, _ in rows[:60]] + ["Größe & Maß, 12 Stück!", "a", "漢字 und Wörter", "the and of " * 3000, "x" * 40_000]
    for text, (lang, score, share) in zip(texts, model.predict(texts), strict=True):
        wanted = brute_prediction(model, text)
        assert lang == wanted[0] and score == pytest.approx(wanted[1], abs=1e-4) and share == pytest.approx(wanted[2], abs=1e-9)


def test_samples_keep_their_bounds(shipped, monkeypatch):
    monkeypatch.setattr(language_id, "FIT_ROWS_EACH", 30)
    monkeypatch.setattr(language_id, "FIT_ROWS", 90)
    monkeypatch.setattr(language_id, "FIT_LANGUAGES", 4)
    rows = [(k, "some words of a text", f"l{k % 3 if k < 1500 else k}") for k in range(1600)]
    df = shipped.createDataFrame(rows, "id long, text string, lang string")
    got = language_id.labelled_sample(df).collect()
    assert {r.lang for r in got} <= {"l0", "l1", "l2", "l1500"} and {"l0", "l1", "l2"} <= {r.lang for r in got}
    assert len(got) < 130
    monkeypatch.setattr(language_id, "FIT_BYTES", 2000)
    assert 0 < language_id.labelled_sample(df).count() < 60
    long = shipped.createDataFrame([(1, "the and of with that " * 100_000, "en"), (2, "der und die das " * 100_000, "de")], "doc_id long, text string, lang string")
    monkeypatch.undo()
    assert {r.lang_pred for r in language_id.predict(long, language_id.train(long)).collect()} == {"en", "de"}


def test_trigrams_and_least_share_are_those_of_all_labelled_rows(shipped, monkeypatch):
    monkeypatch.setattr(language_id, "FIT_ROWS_EACH", 20)
    monkeypatch.setattr(language_id, "COUNTED_LANGUAGES", 2)
    rng = random.Random(21)
    rows = [(k, " ".join(rng.choices(SAMPLES[lang], k=rng.randrange(3, 30))), lang) for k, lang in enumerate(rng.choices(["en", "de", "fr", "es"], k=1900))]
    rows += [(k, " ".join(SAMPLES["xx"]), "xx") for k in range(1900, 1903)]  # rare, but its trigrams are known
    rows += [(k, "".join(rng.choices("bcdfghjkmpqvwxyz", k=60)), "en") for k in range(1903, 1913)]  # odd rows add no trigrams
    rows += [(2000, "the and of", None), (2001, "12 !", "en"), (2002, None, "de")]
    df = shipped.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    usable = [(t, lang) for _, t, lang in rows if lang and t and any(c.isalpha() for c in t)]
    three, found = language_id.ORDERS.index(3), []
    for text, lang in usable:
        (codes,) = language_id.grams([text])
        data = (" " + text).encode()
        found.append((lang, [int(codes[three][at]) for at in range(len(data)) if data[at] != 32]))
    total, sizes = Counter(b for _, own in found for b in set(own)), Counter(lang for _, lang in usable)
    of_lang = Counter((lang, b) for lang, own in found for b in set(own))

    def known(bucket, more):
        return total[bucket] >= 1 + len(found) // 500 + more or any(of_lang[lang, bucket] >= 2 + n // 500 + more for lang, n in sizes.items())

    wanted = {b for b in total if known(b, 0)}
    shares = sorted(((sum(known(b, 1) for b in own) + 8) / (len(own) + 8), min(sizes[lang], 50) / sizes[lang]) for lang, own in found)
    weights = np.cumsum([w for _, w in shares])
    model = language_id.train(df)
    assert set(np.flatnonzero(model.known).tolist()) == wanted
    assert model.least_share == pytest.approx(0.9 * shares[int((weights > (weights[-1] - 1) / 100).argmax())][0], abs=1e-12)
    rare, odd = (share for _, _, share in model.predict([rows[1900][1], rows[1910][1]]))
    assert rare == 1.0 and odd < 0.5


def test_low_shares_are_found_by_their_bits(shipped, monkeypatch):
    rng = random.Random(3)
    value = lambda: rng.choice([0.0, 1.0, 0.5, rng.random(), rng.random() / 1e6, 0.7 + rng.random() / 1e14])
    rows = [(lang, value()) for lang, n in (("en", 400), ("de", 100), ("xx", 7)) for _ in range(n)]
    sizes = Counter(lang for lang, _ in rows)
    df = shipped.createDataFrame([(lang, int(np.float64(v).view(np.int64))) for lang, v in rows], "lang string, bits long")
    for part in (1000, 9, 3, 2):
        monkeypatch.setattr(language_id, "LOW_ROWS", part)
        left = (sum(min(n, 50) for n in sizes.values()) - 1) / part
        for wanted in sorted(v for _, v in rows):
            if sum(min(sizes[lang], 50) / sizes[lang] for lang, v in rows if v <= wanted) > left:
                break
        assert language_id.low_share(df, shipped.createDataFrame(list(sizes.items()), "lang string, rows long")) == wanted


def test_language_of_the_test_data_held_out(shipped):
    docs = shipped.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id.query(shipped, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang_pred <> 'und'").toPandas()
    assert (out.lang == out.lang_pred).mean() >= 0.97


# nearest neighbours


def brute_nearest(rows, is_query, k):
    good = {}
    for key, v in rows:
        if key is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[key] = min(good.get(key, v), v, key=lambda x: (len(x), x))
    out = {}
    for q in filter(is_query, good):
        scores = [(-float(np.dot(np.float64(good[q]), np.float64(v))), key) for key, v in good.items() if key != q and len(v) == len(good[q])]
        out[q] = sorted(scores)[:k]
    return out


def test_few_vectors_are_found_exactly(shipped):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 0.5]), (4, [0.0, 0.0]), (5, None), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0, None]), (9, []), (20, [-1.0, 0.25]), (None, [1.0, 1.0]), (3, [0.5, 0.25]), (40, [2.0, 1.0]), (60, [1.0, 2.0, 3.0]), (61, [0.0, 0.0, 1.0]), (62, [3.0, 2.0, 1.0]), (80, [1.0]), (100, [1.0, 2.0, 3.0, 4.0]), (100, [9.0, 9.0])]
    df = shipped.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, part string")
    got: dict = {}
    for r in learned_ann.search(df, F.col("id") % 20 == 0, k=4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    assert got == {q: own for q, own in brute_nearest(rows, lambda q: q % 20 == 0, 4).items() if own}
    assert learned_ann.search(df.limit(0), F.col("id") % 20 == 0).collect() == []
    assert learned_ann.search(df.where("vec_id = 0"), F.col("id") % 20 == 0).collect() == []


@pytest.mark.parametrize("hot", [0, 700])
def test_recall(shipped, monkeypatch, hot):
    monkeypatch.setattr(learned_ann, "FIT_ROWS", 1024)
    monkeypatch.setattr(learned_ann, "PART_ROWS", 200)
    monkeypatch.setattr(learned_ann, "BLOCK_ROWS", 150)
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(40, 24))
    vectors = centres[rng.integers(0, 40, 2500)] + 0.35 * rng.normal(size=(2500, 24))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors[:hot] = vectors[0]
    rows = [(k, v.astype(np.float32).tolist()) for k, v in enumerate(vectors)]
    df = shipped.createDataFrame(rows, "vec_id long, embedding array<float>")
    wanted = brute_nearest(rows, lambda q: q % 20 == 0, 10)
    got: dict = {}
    for r in learned_ann.search(df, F.col("id") % 20 == 0, k=10).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(wanted) and all(len(v) == 10 for v in got.values())
    found = [len({k for k, _ in got[q]} & {k for _, k in wanted[q]}) / 10 for q in wanted]
    assert np.mean(found) >= 0.9
    for q, own in got.items():
        assert own == sorted(own, key=lambda x: (-x[1], x[0]))
        for k, score in own:
            assert score == pytest.approx(float(np.dot(np.float64(rows[q][1]), np.float64(rows[k][1]))), abs=1e-12)
    if hot:
        assert [k for k, _ in got[20]] == list(range(10))


def test_clusters_need_few_parts():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(200, 64))
    vectors = (centres[rng.integers(0, 200, 4096)] + 0.35 * rng.normal(size=(4096, 64))).astype(np.float32)
    network, visits = learned_ann.fit(vectors / np.linalg.norm(vectors, axis=1, keepdims=True), 32, 20)
    assert visits <= 0.3 * 32


def test_long_vectors_whose_products_cancel(shipped):
    """The matrix product may be wrong by more than the difference of two candidates."""
    rng = np.random.default_rng(3)
    rows = []
    for k in range(300):
        half = rng.normal(size=16) * 1e8
        rows.append((k, [*half.tolist(), *(-half + rng.normal(size=16) * 1e-7).tolist()]))
    rows[0] = (0, [1e8] * 32)
    df = shipped.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in learned_ann.search(df, F.col("id") == 0, k=5).orderBy("rank").collect()]
    plain = lambda a, b: float(np.cumsum(np.float64(a) * np.float64(b))[-1])
    assert got == [(key, -s) for s, key in sorted((-plain(rows[0][1], v), key) for key, v in rows[1:])[:5]]


def test_without_networks_blocks_are_searched_whole(shipped, monkeypatch):
    monkeypatch.setattr(learned_ann, "MAX_NETWORKS", 0)
    monkeypatch.setattr(learned_ann, "BLOCK_ROWS", 900)
    rng = np.random.default_rng(6)
    rows = [(k, rng.integers(-3, 4, 3).astype(float).tolist()) for k in range(2500)]
    df = shipped.createDataFrame(rows, "vec_id long, embedding array<double>")
    got: dict = {}
    for r in learned_ann.search(df, F.col("id") >= 0, k=3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    assert got == brute_nearest(rows, lambda q: True, 3)


def test_parts_are_balanced():
    rng = np.random.default_rng(0)
    graph = learned_ann.neighbour_graph(rng.normal(size=(400, 8)), 6)
    part = learned_ann.balanced_parts(graph, 8)
    assert np.bincount(part, minlength=8).max() <= np.ceil(1.1 * 50)
    assert (part[graph] == part[:, None]).mean() > 0.3


# the pipeline


def test_pipeline(shipped, tmp_path, near_copies, passages):
    import corpus_pipeline

    number = iter(range(10_000))
    rows = [(next(number), t, "en", "s", len(t or "")) for _, t in [*near_copies, *passages] if t is None or len(t) < 20_000]
    rows += [(next(number), "12345 !!", "en", "s", 8), (next(number), "the word", None, None, 8)]
    df = shipped.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stages = []
    for _, stage in corpus_pipeline.STAGES:
        df = stage(shipped, df, str(tmp_path))
        df.write.parquet(str(tmp_path / str(len(stages))))
        df = shipped.read.parquet(str(tmp_path / str(len(stages))))
        stages.append(df)
    first = {r.doc_id: r.text for r in stages[0].collect()}
    assert set(first) == {d for d, t, *_ in rows if t and any(c.isalpha() for c in t)}
    assert {r.lang for r in stages[0].collect()} == {"en"}
    wanted = brute_groups(list(first.items()))
    keep = {list(first)[k] for k, v in wanted.items() if v[0] == list(first)[k]}
    second = {r.doc_id: r.text for r in stages[1].collect()}
    assert set(second) == keep and all(second[d] == first[d] for d in keep)
    gone = brute_spans(sorted(second.items()), 50)
    for r in stages[2].collect():
        old = second[r.doc_id]
        assert brute_words(r.text) == [w for k, w in enumerate(brute_words(old)) if k not in gone.get((r.doc_id, old), set())]
        assert r.n_chars == len(r.text)
    assert all(s.columns == ["doc_id", "text", "lang", "source", "n_chars"] for s in stages[:3])
    assert {r.doc_id for r in stages[3].collect()} == keep


def test_pipeline_rejects_what_is_in_no_known_language(shipped):
    import corpus_pipeline

    rng = random.Random(4)
    foreign = [
        "w szczebrzeszynie chrząszcz brzmi w trzcinie i szczebrzeszyn z tego słynie że każdy może przyjść i zobaczyć",
        "nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura che la diritta via era smarrita",
        "mieleni minun tekevi aivoni ajattelevi lähteäni laulamahan saa'ani sanelemahan sukuvirttä suoltamahan",
        "мой дядя самых честных правил когда не в шутку занемог он уважать себя заставил и лучше выдумать не мог",
        "床前明月光 疑是地上霜 举头望明月 低头思故乡",
    ]
    foreign += [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(n)) for n in (3, 10, 100, 1000)]
    docs = shipped.read.parquet("/root/testdata/sf0.01/documents.parquet")
    clean = docs.where("doc_id % 5 = 1").withColumn("lang", F.lit(None).cast("string"))
    extra = shipped.createDataFrame([(10**9 + k, t, lang, "s", len(t)) for k, t in enumerate(foreign) for lang in (None, "en")], docs.schema)
    got = {r.doc_id for r in corpus_pipeline.known_language(shipped, docs.where("doc_id % 5 <> 1").unionByName(clean).unionByName(extra), "").select("doc_id").collect()}
    assert got == {r.doc_id for r in docs.select("doc_id").collect()}


def test_pipeline_keeps_one_text_of_a_repeated_id(shipped):
    import corpus_pipeline

    words = prose(random.Random(1), 100)
    near = [" ".join(words), " ".join([*words, "end"])]
    rows = [(1, near[0]), (1, near[1]), (1, "another text of the same id"), (2, near[0])]
    df = shipped.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.no_near_duplicates(shipped, df, "").collect()]
    assert len(kept) == 2 and (1, rows[2][1]) in kept and {k for k, _ in kept} == {1}


def test_pipeline_of_odd_tables(shipped, tmp_path):
    import corpus_pipeline

    kinds = "doc_id long, text string, lang string, source string, n_chars long, id string, row string, digest string"
    for number, rows in enumerate([[], [(None, "a text without id", None, None, None, "x", "y", "z"), (1, None, None, None, None, "x", "y", "z"), (2, "a word", "en", "s", 6, "x", "y", "z"), (2, "a word", "en", "s", 6, "x", "y", "z")]]):
        df = shipped.createDataFrame(rows, kinds)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            df = stage(shipped, df, str(tmp_path))
            df.write.parquet(str(tmp_path / f"{number}-{k}"))
            df = shipped.read.parquet(str(tmp_path / f"{number}-{k}"))
            if k < 3:
                assert df.columns == [part.split()[0] for part in kinds.split(", ")]
        assert sorted(str(r.doc_id) for r in df.collect()) == (["2", "None"] if rows else [])
