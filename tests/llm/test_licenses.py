"""Matching statistics and chains of the licence scan against brute force, and whole licence texts."""

import random

import pytest

from cohortloom.llm import licenses as L


def brute_statistics(words, templates):
    """Of every word the longest run that ends there and stands in a template or a phrase."""
    held = {tuple(t[i:j]) for t in templates for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    return [max((k for k in range(1, at + 2) if tuple(words[at + 1 - k : at + 1]) in held), default=0) for at in range(len(words))]


def brute_runs(words, templates):
    """(last word, length) of the runs of MIN_RUN or more that can't grow to the right."""
    n = brute_statistics(words, templates)
    return [(at, k) for at, k in enumerate(n) if k >= L.MIN_RUN and (at + 1 == len(n) or n[at + 1] <= k)]


def brute_spans(words, names, templates):
    """Each template's chains: a run goes on from the one before if it starts within the gap and stands further on in the template."""
    done = []
    for name, t in zip(names, templates):
        chain = None
        for last, k in brute_runs(words, templates_all):
            run = words[last + 1 - k : last + 1]
            ends = [e for e in range(k - 1, len(t)) if t[e + 1 - k : e + 1] == run]
            if not ends:
                continue
            want = chain[2] if chain else -1
            at = min([e for e in ends if e > want] or ends)
            start = last - k + 1
            if chain and start - chain[1] <= L.MAX_GAP + 1 and at > chain[2]:
                chain = [chain[0], last, at, chain[3] + min(k, at - chain[2])]
            else:
                if chain:
                    done.append((name, chain))
                chain = [start, last, at, k]
        if chain:
            done.append((name, chain))
    return sorted(((name, c[0], c[1], min(1.0, c[3] / len(t))) for (name, c) in done for t in [templates[names.index(name)]]), key=lambda x: (x[1], x[2], x[0]))


templates_all: list = []


def test_statistics_and_chains_against_brute_force():
    r = random.Random(6)
    for _ in range(60):
        alphabet = [f"w{k}" for k in range(r.choice([3, 6, 20]))]
        texts = {f"t{k}": " ".join(r.choices(alphabet, k=r.randrange(1, 30))) for k in range(4)}
        base = {"w0 w1": "a", "w1 w0 w1": "b"}
        scanner = L.LicenseScanner(texts, base)
        split = [t.encode().split() for t in texts.values()]
        global templates_all
        templates_all = [*split, *(p.encode().split() for p in base)]
        some = []
        for _ in range(6):
            t = r.choice(split)
            at = r.randrange(len(t))
            some += t[at : at + r.randrange(1, 15)] + [b"none"] * r.randrange(3) + r.choices([x.encode() for x in alphabet], k=r.randrange(3))
        assert scanner.matching_statistics(some) == brute_statistics(some, templates_all)
        found = scanner.scan(b" ".join(some).decode())
        assert found["spans"] == brute_spans(some, list(texts), split)
        for state in range(1, len(scanner.automaton.link)):
            assert len(set(scanner.automaton.occurrences(state))) == len(scanner.automaton.occurrences(state)) > 0
        assert sorted(found["places"]) == sorted((i, label) for p, label in base.items() for i in range(len(some)) if some[i : i + len(p.split())] == p.encode().split())


def test_whole_licences_label_themselves_and_prose_nothing():
    scanner = L.LicenseScanner()
    texts = L.templates_of()
    assert len(texts) >= 25 and sum(len(L.words_of(t)) for t in texts.values()) > 25_000
    for name, text in texts.items():
        found = scanner.scan(f"Copyright 2024 someone\n\n{text}\n\nint main() {{}}")
        assert found["score"] == 1.0 and L.re.sub("-(line|notice|grant)$", "", name) in found["labels"], name
    cut = scanner.scan(" ".join(L.words_of(texts["gpl-3.0"])[i].decode() for i in range(5700) if i % 97 or i > 5000))
    assert "gpl-3.0" in cut["labels"] and 0.6 <= cut["score"] <= 1.0
    prose = scanner.scan("The committee met in the morning and, subject to the terms of the agreement, went on to the next item without any further delay. " * 50)
    assert prose["labels"] == set() and prose["score"] < 0.2


def test_long_texts_and_bounds(monkeypatch):
    scanner = L.LicenseScanner()
    text = L.templates_of()["gpl-2.0"]
    assert scanner.scan(text * 60)["words"] == 60 * len(L.words_of(text))
    monkeypatch.setattr(L, "MOST_WORDS", 10)
    with pytest.raises(ValueError, match="more than 10 words"):
        L.LicenseScanner()


def test_scan_of_rows(spark):
    df = spark.createDataFrame([(1, "MIT License", "x", 1), (None, None, None, 2), (1, "MIT License", "x", 1)], "doc_id long, text string, labels string, score long")
    got = [(r["doc_id"], r["n_words"], r["n_base"], r["labels"], r["score"]) for r in L.license_scan(df).collect()]
    assert sorted(got, key=str) == sorted([(1, 2, 1, "mit", 1.0)] * 2 + [(None, 0, 0, "", 0.0)], key=str)
    assert L.license_scan(df.limit(0)).count() == 0
