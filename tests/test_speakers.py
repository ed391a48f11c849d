"""Speakers of quotes: cases of each method, against a plain implementation over made paragraphs, and edge cases."""

from __future__ import annotations

import random
import re

import pytest

from folium.functions import scan
from folium.operators import speakers

PROFILES = [("Mina",), ("Reza",), ("Anna Lee",), ("Lee",)]
ALIASES = [("Mina", "Min"), ("Reza", "the Captain"), ("Anna Lee", "Annie-Lou")]
NAME, ALIAS, PRONOUN, AMBIGUOUS, NONE = speakers.BY_NAME, speakers.BY_ALIAS, speakers.BY_PRONOUN, speakers.AMBIGUOUS, speakers.NO_CUE

CASES = [
    ('"Stay here," Mina said.', [("Mina", NAME)]),
    ('"Stay here," said Mina.', [("Mina", NAME)]),
    ('Mina asked Reza, "Ready?"', [("Mina", NAME)]),
    ('"Ready?" Mina asked Reza.', [("Mina", NAME)]),
    ('"Yes," said the Captain.', [("Reza", ALIAS)]),
    ('"Yes," he said.', [(None, PRONOUN)]),
    ('She whispered, "Go."', [(None, PRONOUN)]),
    ('Said she, "Go."', [(None, NONE)]),
    ('"Yes."', [(None, NONE)]),
    ('"Stay," said Mina, while Reza replied softly.', [(None, AMBIGUOUS)]),
    ('Mina said. It rained. "Go."', [(None, NONE)]),
    ('Mina said "Yes. No." and "Go."', [("Mina", NAME), (None, NONE)]),
    ('"A," "B," Mina said.', [(None, NONE), ("Mina", NAME)]),
    ('“Mina said so,” Reza muttered.', [("Reza", NAME)]),
    ("— Stay here.\nReza called.", [("Reza", NAME)]),
    ("«Go!» cried Anna Lee.", [("Anna Lee", NAME)]),
    ("«Go!» Anna Lee cried.", [(None, AMBIGUOUS)]),
    ('"No," Annie-Lou answered.', [("Anna Lee", ALIAS)]),
    ('"No," ' + "x " * 46 + "Mina said.", [("Mina", NAME)]),
    ('"No," ' + "x " * 48 + "Mina said.", [(None, NONE)]),
    ('"No," Mina walked.', [(None, NONE)]),
    ('Mina "said hello" and "went".', [("Mina", NAME), (None, NONE)]),
]


@pytest.fixture(scope="module")
def names(spark):
    return spark.createDataFrame(PROFILES, "name string"), spark.createDataFrame(ALIASES, "canonical_name string, alias string")


def asked(spark, names, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "paragraph int, text string")
    out = speakers.attribute(rows, *names).collect()
    by = {}
    for r in sorted(out, key=lambda r: (r["paragraph"], r["quote_index"])):
        by.setdefault(r["paragraph"], []).append(r)
    return [by.get(i, []) for i in range(len(texts))]


def test_cases(spark, names):
    got = asked(spark, names, [t for t, _ in CASES])
    assert [[(r["speaker"], r["method"]) for r in rows] for rows in got] == [want for _, want in CASES]


def test_every_verb_makes_a_cue(spark, names):
    got = asked(spark, names, [f'"Yes," Mina {v}.' for v in (*speakers.SPEECH_VERBS, "walks", "thought")])
    assert [rows[0]["speaker"] for rows in got] == ["Mina"] * len(speakers.SPEECH_VERBS) + [None, None]


def plain(text):
    """The rules word by word, for texts of ASCII letters."""
    quotes = [(q["start"], q["end"]) for q in scan._quotes(text)]
    tokens = [(re.sub("[^a-z0-9]+", " ", m.group().lower()).strip(), m.start(), m.end(), m.group()) for m in re.finditer(r"[\w'’-]+", text)]
    tokens = [t for t in tokens if t[0]]
    words = lambda n: [re.sub("[^a-z0-9]+", " ", w.lower()).strip() for w in re.findall(r"[\w'’-]+", n)]
    patterns = sorted([(words(n), n, n, False) for (n,) in PROFILES] + [(words(a), c, a, True) for c, a in ALIASES], key=lambda p: (-len(p[0]), p[1], p[2]))
    verb = lambda i: 0 <= i < len(tokens) and tokens[i][0] in speakers.SPEECH_VERBS
    inside = lambda a, b: any(a >= s and b <= e for s, e in quotes)
    cues = []
    for w, canonical, mention, alias in patterns:
        for i in range(len(tokens) - len(w) + 1):
            j = i + len(w)
            if [t[0] for t in tokens[i:j]] == w and not inside(tokens[i][1], tokens[j - 1][2]) and (verb(j) or verb(i - 1)):
                cues.append((canonical, mention, alias, tokens[i][1], tokens[j - 1][2], verb(j), tokens[j if verb(j) else i - 1]))
    pronouns = [(t[1], t[2], verb(i + 1), verb(i - 1)) for i, t in enumerate(tokens) if t[0] in speakers.PRONOUNS and not inside(t[1], t[2]) and (verb(i + 1) or verb(i - 1))]

    def parted(a, b, q):
        return any(o != q and (o[0] >= b and o[1] <= q[0] if b <= q[0] else o[0] >= q[1] and o[1] <= a) for o in quotes)

    out = []
    for q in quotes:
        near = lambda a, b, q=q: (b <= q[0] and q[0] - b <= 96 or a >= q[1] and a - q[1] <= 96) and not parted(a, b, q)
        found = []
        for c in cues:
            if near(c[3], c[4]) and (not (c[4] <= q[0]) or c[5] and not re.search("[.!?]", text[c[6][2] : max(c[6][2], q[0])])):
                found.append(c)
        taken = {c[6][1] for c in found if c[5]}
        by = {}
        for c in found:
            if c[5] or c[6][1] not in taken:
                by.setdefault(c[0].lower(), c)
        if len(by) == 1:
            c = next(iter(by.values()))
            out.append((c[0], ALIAS if c[2] else NAME, f"{c[1]} {c[6][3]}" if c[5] else f"{c[6][3]} {c[1]}"))
        elif by:
            out.append((None, AMBIGUOUS, " | ".join(by[k][0] for k in sorted(by))))
        else:
            said = any(near(a, b) and (then if b <= q[0] else True) for a, b, then, _ in pronouns)
            out.append((None, PRONOUN if said else NONE, None))
    return out


def test_made_paragraphs_equal_the_plain_rules(spark, names):
    rng = random.Random(11)
    pieces = ["Mina", "Reza", "Min", "the Captain", "Anna Lee", "Lee", "said", "asked", "replied", "she", "He", "walked", "and", "then", '"', '"', "“", "”", "‘", "’", "«", "»", ",", ".", "?", "\n", "\n— ", "mina's", "x" * 30]
    texts = ["".join(rng.choice(pieces) + rng.choice([" ", " ", ""]) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    got = asked(spark, names, texts)
    for text, rows in zip(texts, got, strict=True):
        assert [(r["speaker"], r["method"], r["evidence"]) for r in rows] == plain(text), text


def test_context_and_edges(spark, names):
    text = "\n".join(f'"Line {i} \\ of\tit," Mina said.' for i in range(20))
    rows = spark.createDataFrame([(1, text), (2, '"Nobody."'), (3, None), (4, "")], "paragraph int, text string")
    out = speakers.attribute(rows, *names)
    context = speakers.speaker_context(out).collect()
    assert [r["paragraph"] for r in context] == [1]
    lines = context[0]["context"].split("\n")
    assert len(lines) == 17 and lines[1] == '- "Line 0 \\\\ of\\tit," → Mina (explicit_name_speech_verb)'
    assert speakers.attribute(rows.limit(0), *names).count() == 0
    nobody = names[0].limit(0), names[1].limit(0)
    assert {r["method"] for r in speakers.attribute(rows, *nobody).collect()} == {NONE}


def test_tokens_have_offsets(spark):
    row = spark.createDataFrame([(1, "Él said: “don’t”. A-b!"), (2, "")], "paragraph int, text string")
    got = [tuple(r)[1:] for r in speakers.lexical_tokens(row).orderBy("n").collect()]
    assert got == [(0, "Él", "él", 0, 2, 16), (1, "said", "said", 3, 7, 16), (2, "don’t", "do not", 10, 15, 16), (3, "A-b", "a b", 18, 21, 21)]
