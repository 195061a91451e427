import re
import textwrap

from loomline.llm import licences
from tests.llm.support import DOC_SCHEMA, EDGES, edge_docs, empty_docs

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(rows, templates=licences.TEMPLATES, percent=licences.CONTAINMENT):
    out = []
    for i, t, *_ in rows:
        lines = [WORD.findall(x.translate(FOLD)) for x in (t or "").split("\n")]
        words = [w for x in lines for w in x]
        base, at = set(), []
        for phrase, label in licences.PHRASES.items():
            p = phrase.split()
            hits = [k for k in range(len(words) - len(p) + 1) if words[k:k + len(p)] == p]
            at += hits
            base |= {label} if hits else set()
        found, best = set(base), 0.0
        for label, wording in templates.values():
            w = set(wording.split())
            for x in lines:
                if 100 * len(w & set(x)) >= percent * len(w):
                    found.add(label)
                    best = max(best, len(w & set(x)) / len(w))
        out.append((i, len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(found)), 1.0 if at else best))
    return sorted(out, key=str)


def got_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


ROWS = [
    (1, "MIT License\nTHE mit  license, and the Apache-License", "", "", 0), (2, "the gnu\ngeneral\npublic license", "", "", 0), (3, "general public licenses", "", "", 0),
    (4, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", "", "", 0),
    (5, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "", "", 0), (6, "Licensed under CC BY-NC 4.0.", "", "", 0), (7, "cc by nc 4 0", "", "", 0),
    (8, "mit license mit license mit", "", "", 0), (9, "mit\x00license MİT LICENSE Kelvin", "", "", 0),
]


def test_against_brute_force(spark):
    assert got_of(licences.scan_licences(spark.createDataFrame(ROWS, DOC_SCHEMA))) == brute(ROWS)


def test_lower_threshold_and_own_templates(spark):
    own = {"x": ("x", "a b c d e"), "y": ("y", "c d e f g h"), "z": ("x", "h")}
    rows = [(i, t, "", "", 0) for i, t in enumerate(["a b c", "c d e f", "f g h c\na b", "h", "", "a a a a b b b c", "d e f g z z z", "b c d e\nh q"])]
    for percent in (40, 60, 80, 100):
        assert got_of(licences.scan_licences(spark.createDataFrame(rows, DOC_SCHEMA), own, percent)) == brute(rows, own, percent)
    assert got_of(licences.scan_licences(spark.createDataFrame(rows, DOC_SCHEMA), {})) == brute(rows, {})


def test_edges(spark):
    assert got_of(licences.scan_licences(edge_docs(spark))) == brute(EDGES)
    assert licences.scan_licences(empty_docs(spark)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = licences.scan_licences(edge_docs(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def brute_wrapped(rows, templates=licences.TEMPLATES, percent=licences.CONTAINMENT):
    out = []
    for line, row in zip((brute([r], templates, percent)[0] for r in rows), rows):
        text = (row[1] or "").translate(FOLD)
        words = WORD.findall(text)
        found, best = set(filter(None, line[5].split(","))), 0.0
        for label, wording in templates.values():
            w, span = set(wording.split()), licences.SPAN * len(wording.split())
            blocks = [WORD.findall(x) for x in re.split("\n[ \t\r]*\n", text)] + [words[k:k + span] for k in range(len(words))]
            most = max(len(w & set(x)) for x in blocks) if blocks else 0
            if 100 * most >= percent * len(w):
                found.add(label)
                best = max(best, most / len(w))
        out.append((*line[:6], ",".join(sorted(found)), 1.0 if line[2] else best))
    return sorted(out, key=str)


def wrapped(label, mark, blank_after=()):
    """A template at 60 columns behind a comment mark, with a comment line left empty here and there."""
    lines = textwrap.wrap(next(w for n, (_, w) in licences.TEMPLATES.items() if n == label), 60)
    return "\n".join(x for k, line in enumerate(lines) for x in [mark + line, *([mark.rstrip()] if k in blank_after else [])])


WRAPPED = [
    (20, "#!/bin/sh\n" + wrapped("mit-grant", "# ") + "\n\necho done", "", "", 0), (21, "/*\n" + wrapped("gpl-terms", " * ", (0,)) + "\n */\nint x;", "", "", 0),
    (22, wrapped("apache-terms", "// "), "", "", 0), (23, wrapped("bsd-terms", "", (0, 1)), "", "", 0), (24, " ".join(licences.TEMPLATES["bsd-terms"][1].split()[:12]) + "\n\nother words", "", "", 0),
    (25, "\n".join(w + " filler" * 40 for w in licences.TEMPLATES["bsd-terms"][1].split()), "", "", 0), (26, "\n\n".join(w + " filler" * 40 for w in licences.TEMPLATES["bsd-terms"][1].split()), "", "", 0),
]


def test_wrapped_headers_against_brute_force(spark):
    rows = [*ROWS, *EDGES[:5], *EDGES[7:], *WRAPPED]
    got = got_of(licences.scan_licences(spark.createDataFrame(rows, DOC_SCHEMA), wrapped=True))
    assert got == brute_wrapped(rows)
    labels = {r[0]: r[6] for r in got}
    assert [labels[i] for i in range(20, 27)] == ["mit", "gpl", "apache", "bsd", "", "bsd", ""]
    assert {r[6] for r in brute(WRAPPED) if r[0] in (20, 22, 23)} == {""}


def test_wrapped_own_templates(spark):
    own = {"x": ("x", "a b c d e"), "y": ("y", "c d e f g h"), "z": ("x", "h")}
    rows = [(i, t, "", "", 0) for i, t in enumerate(["a b c", "c d e f", "f g h c\na b", "h", "", "a a a a b b b c", "d e f\n\ng z z z", "b c d e\nh q", "a q q q q q q\n\nq q q b\n\nc d e"])]
    for percent in (40, 60, 80, 100):
        assert got_of(licences.scan_licences(spark.createDataFrame(rows, DOC_SCHEMA), own, percent, wrapped=True)) == brute_wrapped(rows, own, percent)
    assert got_of(licences.scan_licences(spark.createDataFrame(rows, DOC_SCHEMA), {}, wrapped=True)) == brute_wrapped(rows, {})


def test_wrapped_edges(spark):
    assert licences.scan_licences(edge_docs(spark), wrapped=True).count() == len(EDGES)
    assert licences.scan_licences(empty_docs(spark), wrapped=True).count() == 0
