import math
import re

from creditweave.llm import licenses
from creditweave.llm.licenses import BASE_PHRASES, TEMPLATES, scan
from tests.llm.corpus import documents, numbered, prose, texts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(values, entries=4, looked_up=12, agreeing=2, least=0.75):
    """The scan by plain loops over every place of every file."""
    files = [words(v) for v in values]
    vocabulary = {w for t in TEMPLATES for w in t.words}
    idf = {w: math.log((1 + len(files)) / (1 + sum(w in f for f in files))) + 1 for w in vocabulary}
    rarest = [sorted(set(t.words), key=lambda w: (-idf[w], w))[:entries] for t in TEMPLATES]
    indexed = sorted({w for found in rarest for w in found}, key=lambda w: (-idf[w], w))
    out = []
    for found in files:
        base = {p: [i for i in range(len(found)) if found[i : i + len(p.split())] == p.split()] for p in BASE_PHRASES}
        places = [i for at in base.values() for i in at]
        rare = [w for w in indexed if w in found][:looked_up]
        labels, best = {BASE_PHRASES[p] for p, at in base.items() if at}, 0.0
        for number, t in enumerate(TEMPLATES):
            # The key phrase is mandatory, so its first word gives every possible start.
            first = t.phrase.split()[0]
            for at in (i - t.phrase_at for i, w in enumerate(found) if w == first):
                def stands(j):
                    return 0 <= at + j < len(found) and found[at + j] == t.words[j]
                votes = sum(stands(j) for j, w in enumerate(t.words) if w in rarest[number] and w in rare)
                phrase = range(t.phrase_at, t.phrase_at + len(t.phrase.split()))
                if votes >= agreeing and all(map(stands, phrase)):
                    share = sum(idf[w] for j, w in enumerate(t.words) if stands(j)) / sum(idf[w] for w in t.words)
                    if share >= least:
                        labels.add(t.label)
                        best = max(best, share)
        out.append((len(found), len(places), min(places, default=None), max(places, default=None),
                    ",".join(sorted({BASE_PHRASES[p] for p, at in base.items() if at})), ",".join(sorted(labels)),
                    1.0 if places else best))
    return out


LINES = [
    "Licensed under the Apache License, Version 2.0.",
    "Released under the MIT License.",
    "This work is licensed under the GNU General Public License, version 3.",
    "Licensed under CC BY-NC 4.0. and again CC-BY-NC",
    "Under the\nMIT * license",
    "under the mit licenses",
    "under the mit k license under the mit K license",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "hereby granted, free of charge, to any person obtaining a copy",
    "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "the GNU General Public License, version 2 license license mit mit",
    "SPDX-License-Identifier: Apache-2.0",
    "éunder the mit license É",
    "Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "software license version under",
]


def check(spark, values):
    every = brute(values)
    for row in scan(numbered(spark, values)).collect():
        want = every[row.doc_id]
        got = (row.n_words, row.n_base, row.first_word, row.last_word, row.base_labels, row.labels)
        assert got == want[:6], (values[row.doc_id], got, want)
        assert abs(row.score - want[6]) < 1e-9


def test_scan_equals_brute_force(spark):
    values = [*texts(), *LINES, *(f"{prose(i, 40)} {line} {prose(i, 9)}" for i, line in enumerate(LINES))]
    check(spark, [*values, " ".join(LINES), " ".join(LINES * 4)])


def test_methods_own_labels(spark):
    got = {r.doc_id: r.labels for r in scan(numbered(spark, LINES)).collect()}
    assert got[2] == "gpl-3" and got[7] == "mit" and got[9] == "bsd" and got[11] == "apache-2"
    assert got[14] == "" and got[13] == "cc-by-sa"


def test_no_python_in_the_plan(spark):
    plan = scan(numbered(spark, LINES))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange hashpartitioning" not in plan


def test_empty_table_and_clashing_columns(spark):
    assert scan(documents(spark, [], "words string")).count() == 0
    one = scan(documents(spark, [(None, LINES[1], "w", "l")], "words string, labels string")).first()
    assert (one.doc_id, one.words, one.labels) == (None, "w", "mit")
    assert licenses.word_idf(documents(spark, []), "text", ["mit"]) == {"mit": 1.0}


def test_file_of_all_notices_keeps_every_label(spark):
    values = [" ; ".join(t.notice for t in TEMPLATES), "\n".join(t.notice for t in reversed(TEMPLATES)), *texts(), *LINES]
    files = [words(v) for v in values]
    rows = {r.doc_id: r for r in scan(numbered(spark, values), looked_up=None).collect()}
    for i, found in enumerate(files):
        # Every template at every place, whole notices only.
        whole = {t.label for t in TEMPLATES for at in range(len(found)) if found[at : at + len(t.words)] == t.words}
        assert whole <= set(rows[i].labels.split(",")), values[i]
    assert set(rows[0].labels.split(",")) == set(rows[1].labels.split(",")) == {t.label for t in TEMPLATES}


def test_query_looks_up_all_words(spark, tmp_path):
    from creditweave.llm.queries import license_scan

    documents(spark, [(1, " ; ".join(t.notice for t in TEMPLATES))]).write.parquet(str(tmp_path / "documents.parquet"))
    assert set(license_scan(spark, str(tmp_path)).first().labels.split(",")) == {t.label for t in TEMPLATES}
