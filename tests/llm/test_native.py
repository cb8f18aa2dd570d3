"""Quotations, licences and line templates."""

from __future__ import annotations

import math
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import licences, line_templates, quotations
from pulsegrid.llm.support import table

MESSAGES = [
    (1, 0, "user", "Hello there.\nHow are you today?"), (1, 1, "assistant", "> How are you  TODAY?\nFine, thanks."), (1, 2, "user", "Another topic."), (1, 3, "user", ">> How are you today?\n> Fine, thanks.\nGood."),
    (1, 4, "assistant", "> Another topic.\nYes?"), (2, 0, "user", "> Another topic.\nNo origin here\n> nonsense\n> hello there."), (2, 1, None, None), (None, 3, "x", "> Good.\nhm"), (3, 1, "user", ""), (3, 1, "user", ""), (4, None, "user", "> Good."),
]


def brute_links(rows):
    """{(conv, turn): (quoted conv, quoted turn, reply)} of rows with distinct keys."""
    norm = lambda s: re.sub(r"[ \t\n\x0b\f\r]+", " ", s.lower()).strip(" ")
    parsed = {}
    for conv, turn, _, text in rows:
        runs = []
        for line in (text or "").split("\n") if text is not None else []:
            marks = re.match(r"^(?:[ \t]*>)+", line)
            level = marks[0].count(">") if marks else 0
            body = re.sub(r"^(?:[ \t]*>)+ ?", "", line) if marks else line
            if runs and runs[-1][0] == level:
                runs[-1][1].append(body)
            else:
                runs.append((level, [body]))
        parsed[conv, turn] = runs
    held = {}
    for key, runs in parsed.items():
        if None in key:
            continue
        own = [r for lv, r in runs if lv == 0]
        for body in {norm("\n".join(r)) for r in own} | {norm(x) for r in own for x in r} | {norm("\n".join(x for r in own for x in r))}:
            held.setdefault(body, set()).add(key)
    out = {}
    for (conv, turn), runs in parsed.items():
        links = []
        for k, (level, lines) in enumerate([r for r in runs if r[0] > 0 and norm("\n".join(r[1]))]):
            for unit in [norm("\n".join(lines)), *map(norm, lines)]:
                keys = held.get(unit, set()) if unit and None not in (conv, turn) else set()
                here = min((t for c, t in keys if c == conv), default=None)
                there = min(((c, t) for c, t in {(c, min(t for c2, t in keys if c2 == c)) for c, _ in keys}), default=None)
                found = (conv, here) if here is not None and here < turn else there if there and there[0] != conv else None
                if found:
                    links.append((level, k, found))
                    break
        links.sort()
        reply = next((f[1] for _, _, f in links if f[0] == conv), None)
        out[conv, turn] = (*(links[0][2] if links else (None, None)), reply)
    return out


def test_quotations(spark):
    rows = spark.createDataFrame(MESSAGES, "conv_id long, turn long, role string, text string").withColumn("lines", F.lit(1)).withColumn("key", F.lit("k"))
    got = quotations.link_quotes(rows).collect()
    assert len(got) == len(MESSAGES) and quotations.link_quotes(rows.limit(0)).count() == 0
    by = {(r.conv_id, r.turn): r for r in got}
    for key, (quoted_conv, quoted_turn, reply) in brute_links(MESSAGES).items():
        assert (by[key].quoted_conv, by[key].quoted_turn, by[key].reply_to) == (quoted_conv, quoted_turn, reply)
    assert [r.turn for r in sorted((r for r in got if r.conv_id == 1), key=lambda r: r.position)] == [0, 1, 3, 2, 4]
    assert by[1, 3].text == "Good." and by[1, 3].depth == 2 and by[1, 3].root_turn == 0 and by[3, 1].position == 1


def test_random_conversations(spark):
    rng = random.Random(2)
    rows, lines = [], [f"line {k} of text" for k in range(12)]
    for conv in range(12):
        for turn in range(10):
            parts = [("> " * rng.randint(1, 2) if rng.random() < 0.5 else "") + rng.choice(lines) + rng.choice(["", " ", f" {conv}"]) for _ in range(rng.randint(1, 4))]
            rows.append((conv, turn, "user", "\n".join(parts)))
    got = {(r.conv_id, r.turn): r for r in quotations.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    want = brute_links(rows)
    assert {k: (r.quoted_conv, r.quoted_turn, r.reply_to) for k, r in got.items()} == want
    for (conv, turn), r in got.items():
        root = turn
        while want[conv, root][2] is not None:
            root = want[conv, root][2]
        assert r.root_turn == root
    for conv in range(12):
        own = sorted((r.root_turn, r.turn, r.position) for r in got.values() if r.conv_id == conv)
        assert [p for *_, p in own] == list(range(1, 11))


def test_licence_model_on_held_out_notices():
    model = licences.train()
    cases = {"Made available under the terms of the MIT license.": "MIT", "Licensed under the Apache License, Version 2.0 (the License)": "Apache", "This is free software under the GNU General Public License version 3.": "GPL", "Text: CC BY-NC 4.0.": "CC-BY-NC", "all rights reserved": "Reserved", "Covered by the Mozilla Public License 2.0": "MPL", "The quick brown fox is under the table.": "unknown", "A driver needs a new license.": "unknown", "": "unknown"}
    for text, family in cases.items():
        p = model.probabilities(text)
        best = model.classes[p.argmax()]
        assert best == family or (family == "unknown" and p.max() < model.least)


#: Bodies as works have them: other holders, quotes and wrapping than in training.
BODY_NOTICES = {
    "BSD": ['* Redistribution and use in source and binary forms, with or without\n* modification, are permitted provided that the following conditions are met:', "3. Neither the name of Example Inc. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "MIT": ['Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction,', 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,'],
    "ISC": ["Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "EPL": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution"],
    "CC0": ["To the extent possible under law, Jane Doe has waived all copyright and related or neighboring rights to this software to the public domain worldwide."],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or\ndistribute this software, either in source code form or as a compiled"],
    "Apache": ['Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,'],
    "GPL": ["This package is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "": ["The software is provided by a small company in the north.", "Permission to enter the park is granted without a fee to any person with a copy of this letter.", "You should have received a copy of the book by now, she said, and not only the notice.", "A person is free to publish or sell any work, in whatever form and for whatever purpose."],
}


def test_licence_bodies(spark):
    cases = [(family, text) for family, texts in BODY_NOTICES.items() for text in texts]
    docs = spark.createDataFrame([(k, text) for k, (_, text) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r.families for r in licences.scan(docs).collect()}
    assert {text: got[k] for k, (_, text) in enumerate(cases)} == {text: family for family, text in cases}


#: Notices and what they are; "" where no licence is named that is known.
NAMED = {
    "This work is licensed under CC BY-ND 4.0.": "CC-BY-ND", "Licensed under CC BY-NC-SA 3.0, see the file.": "CC-BY-NC-SA", "GNU Affero General Public License v3": "AGPL", "Under the terms of the GNU Lesser General Public License, version 3.": "LGPL",
    "Licensed under the Creative Commons\nAttribution 4.0 International License.": "CC-BY", "# SPDX-License-Identifier: MIT": "MIT", "// SPDX-License-Identifier: GPL-3.0-or-later": "GPL", "SPDX-License-Identifier: Apache-2.0": "Apache",
    "Distributed under the Boost Software License, Version 1.0.": "Boost", "Released under the zlib License.": "Zlib", "Artistic License 2.0": "Artistic", "Licensed under the EUPL-1.2": "EUPL", "Licensed under CC BY-XX 4.0.": "",
    "Licensed under the GNU Foo General Public License.": "", "Licensed under the Creative Commons Attribution-Whatever 4.0 International License.": "", "The bar lost its license; the MIT study says so.": "", "Der Text ist mit der Lizenz der Stadt.": "",
    "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.": "GPL",
}


def test_names_of_other_licences(spark):
    docs = spark.createDataFrame([(k, f"Some text before it.\n\n{x}\n\nAnd after.") for k, x in enumerate(NAMED)], "doc_id long, text string")
    got = {r.doc_id: (r.families, r.n_notices, r.n_paragraphs) for r in licences.scan(docs).collect()}
    assert {x: got[k] for k, x in enumerate(NAMED)} == {x: (family, int(family != ""), 3) for x, family in NAMED.items()}


def test_licence_scan(spark, small_docs, no_docs):
    texts = ["Some text.\n\nReleased under the MIT License.\n \t\nMore.", "This work is licensed under the GNU General Public License, version 3.", None, "", "mitten and licence plates\nand nothing", "All rights reserved.\n\n\nLicensed under CC BY-NC 4.0.", "MIT license " + "x " * 9000, "\n \n"]
    docs = spark.createDataFrame([(k % 6, t, k) for k, t in enumerate(texts)], "doc_id long, text string, paragraph long")
    got = sorted(((r.doc_id, r.n_paragraphs, r.n_notices, r.families) for r in licences.scan(docs).collect()))
    assert got == sorted([(0, 3, 1, "MIT"), (1, 1, 1, "GPL"), (2, 0, 0, ""), (3, 0, 0, ""), (4, 1, 0, ""), (5, 2, 2, "CC-BY-NC,Reserved"), (0, 1, 1, "MIT"), (1, 0, 0, "")])
    assert licences.scan(no_docs).count() == 0 and licences.scan(small_docs).where("n_notices > 0").count() == 0


def brute_notices(text: str, model: licences.LicenceModel, overlap: float = 0.75) -> dict[tuple[int, str], float]:
    """Every line of every paragraph, and with the next one, through the model and the templates; no search before."""
    out: dict[tuple[int, str], float] = {}
    for k, block in enumerate(re.split(licences.BLANK, text)):
        lines = block.split("\n")
        for body in [*lines, *(f"{x} {y}" for x, y in zip(lines, lines[1:]))]:
            p = model.probabilities(body)
            family = model.classes[p.argmax()]
            if family != licences.UNKNOWN and p.max() >= model.least and licences.overlap_of(body, family) >= overlap:
                out[k, family] = max(out.get((k, family), 0.0), float(p.max()))
    return out


def test_notices_against_brute_force(spark):
    """All lines of a table and of bodies, with a model that has seen a sample of them: the search by anchors and the joins change nothing."""
    some = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    cases = [(10**6 + k, text) for k, text in enumerate([*NAMED, *(t for own in BODY_NOTICES.values() for t in own), *(" ".join(b) for b in licences.BODIES.values()), "\n".join(NAMED), "\n\n".join(NAMED)])]
    docs = some.unionByName(spark.createDataFrame(cases, "doc_id long, text string"))
    model = licences.train(licences.sample_lines(docs))
    want = {(r.doc_id, *key): p for r in docs.collect() for key, p in brute_notices(r.text, model).items()}
    got = {(r.doc_id, r.paragraph, r.family): r.probability for r in licences.licence_paragraphs(docs, model).collect()}
    assert got.keys() == want.keys() and len(want) > 60
    assert all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_the_sample_is_bounded(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    lines = licences.sample_lines(docs, (20, 5, 40))
    assert 20 < len(lines) <= 100 and max(map(len, lines)) <= 40 and lines == licences.sample_lines(docs.repartition(7), (20, 5, 40))
    model = licences.train(licences.sample_lines(docs))
    assert not {"any", "can", "do", "even", "from", "has", "have", "if", "its", "one", "other", "our", "out"} & set(model.anchors)
    passing = docs.where(F.col("text").rlike(licences.anchor_pattern(model))).count()
    assert passing <= 2 * max(1, licences.scan(docs, model).where("n_notices > 0").count())


def test_a_confirmed_text_has_an_anchor():
    """Names, and pieces of bodies that are long enough to be confirmed, put together from places at random."""
    rng = random.Random(1)
    anchored = re.compile(licences.anchor_pattern(licences.train()))
    for family, (names, bodies) in licences.templates().items():
        assert all(anchored.search(n) for n in names)
        for pairs in bodies:
            for _ in range(50):
                text = ". ".join(rng.sample(pairs, min(licences.LEAST_PAIRS, len(pairs))))
                assert anchored.search(text) or licences.overlap_of(text, family) < 0.75


@pytest.mark.parametrize("source", ["small", "table"])
def test_line_templates(spark, small_docs, source):
    docs = small_docs.where("doc_id is not null").dropDuplicates(["doc_id"]) if source == "small" else table(spark, "/root/testdata/sf0.001", "documents")
    rows = line_templates.drop_templates(docs).select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))
    connection = duckdb.connect()
    connection.register("documents", docs.select("doc_id", "text").toArrow())
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r) for r in rows.collect()), key=key) == sorted(connection.sql(line_templates.ORACLE_SQL).fetchall(), key=key)


def test_variable_fields_are_one_template(spark, no_docs):
    docs = spark.createDataFrame([(k, f"User {k} logged in from host{k} at noon today\nunique {'abcdefgh'[k]} words here\n\n") for k in range(8)] + [(9, None), (None, ""), (3, "User 3 logged in from host3 at noon today")], "doc_id long, text string").withColumn("leaf", F.lit(1))
    got = line_templates.drop_templates(docs).collect()
    assert sorted(r.n_dropped for r in got) == [0, 0] + [1] * 9 and {r.text for r in got if r.doc_id == 2} == {"unique c words here\n\n"}
    assert line_templates.template_lines(docs).select("template").distinct().collect()[0].template == "User <*> logged in from <*> at noon today"
    assert line_templates.drop_templates(no_docs).count() == 0


def test_lines_that_share_their_lead_only_stay(spark):
    """Lines of 4 and 5 tokens agree in their leading three by construction."""
    docs = spark.createDataFrame([(k, f"Was erlytion that. {w}{w} {w}. \nAll of these {w}") for k, w in enumerate("abcdefgh")], "doc_id long, text string")
    assert {r.n_dropped for r in line_templates.drop_templates(docs).collect()} == {0}


def test_templates_under_one_lead(spark):
    """Five templates of eight tokens share their leading three; each has a variable word without a digit."""
    forms = ["Could not open the file {} for reading", "Could not open the socket {} after boot", "Could not open a window {} on screen", "Could not open any door {} at night", "Could not open this letter {} by hand"]
    docs = spark.createDataFrame([(k * 8 + n, form.format(w) + f"\nown line {w}{'vwxyz'[k]}") for k, form in enumerate(forms) for n, w in enumerate("abcdefgh")], "doc_id long, text string")
    got = line_templates.drop_templates(docs).collect()
    assert [r.n_dropped for r in got] == [1] * 40 and all(r.text.startswith("own line") for r in got)
    assert {r.template for r in line_templates.template_lines(docs).collect()} == {form.format("<*>") for form in forms}


@pytest.mark.parametrize("seed,length,anywhere", [(0, 8, False), (1, 8, True), (2, 8, True), (3, 11, True), (4, 9, True)])
def test_fields_at_any_place(spark, seed, length, anywhere):
    """40 templates of one leaf in six documents each, with a variable word at one place or at another place in each line: all of their lines go, and lines that are like no other stay."""
    import random

    rng = random.Random(seed)
    word = lambda size=6: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(size))
    vocabulary, lines, doc = [word() for _ in range(70)], [], 0
    for _ in range(40):
        form, fixed = ["could", "not", "open", *(rng.choice(vocabulary) for _ in range(length - 3))], rng.randrange(3, length)
        for _ in range(6):
            own = list(form)
            own[rng.randrange(3, length) if anywhere else fixed] = word(9)
            lines.append((doc, " ".join(own), 1))
            doc += 1
    lines += [(doc + k, " ".join(["could", "not", "open", *(word(8) for _ in range(length - 4)), rng.choice(vocabulary)]), 0) for k in range(60)]
    rng.shuffle(lines)
    docs = spark.createDataFrame([(k, line) for k, line, _ in lines], "doc_id long, text string")
    got = {r.doc_id: r.n_dropped for r in line_templates.drop_templates(docs).collect()}
    assert got == {k: dropped for k, _, dropped in lines}
    rows = line_templates.drop_templates(docs).select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))
    connection = duckdb.connect()
    connection.register("documents", docs.toArrow())
    assert sorted(tuple(r) for r in rows.collect()) == sorted(connection.sql(line_templates.ORACLE_SQL).fetchall())


def _grouped(lines: dict[str, int], leading: int, agreement: float, least: int, most: int) -> dict[str, str]:
    """The roots of the lines (with their documents) of one leaf, every pair of lines at hand: rounds of leaders while there are more than `most` lines, then line by line."""
    split = {x: x.split(" ")[leading:] for x in lines}
    postings = lambda x: {(k, w) for k, w in enumerate(split[x]) if w != line_templates.ANY}
    like = lambda x, y: len(postings(x) & postings(y)) >= math.ceil(len(split[x]) * agreement)
    rest, out = dict.fromkeys(lines, False), {}
    while len(rest) > most and sum(lines[x] for x in rest) >= least:
        members = {p: [x for x in rest if p in postings(x)] for p in set().union(*map(postings, rest))}
        tops = {p: max((lines[x], x) for x in own if not rest[x]) for p, own in members.items() if len(own) > 1 and any(not rest[x] for x in own)}
        if not tops:
            return out
        seen = {x: {tops[p] for p in postings(x) if p in tops} for x in rest}
        ahead = {x: [t for t in seen[x] if t[1] != x and (rest[x] or t > (lines[x], x)) and like(x, t[1])] for x in rest}
        roots = {x for x in rest if (lines[x], x) in seen[x] and not ahead[x]}
        joined = {x: max((len(postings(x) & postings(t[1])), *t) for t in found)[2] for x, own in ahead.items() if (found := [t for t in own if t[1] in roots])}
        out |= joined | {r: r for r in joined.values()}
        rest = {x: rest[x] or x in roots for x in rest if x not in out and seen[x]}
    if len(rest) > 1 and sum(lines[x] for x in rest) >= least:
        roots, own = [], {}
        for x in sorted(rest, key=lambda x: (lines[x], x), reverse=True):
            best = max(((len(postings(x) & postings(r)), lines[r], r) for r in roots if like(x, r)), default=None)
            own[x] = best[2] if best else x
            roots += [] if best else [x]
        out |= {x: r for x, r in own.items() if list(own.values()).count(r) > 1}
    return out


@pytest.mark.parametrize("seed,most", [(0, 512), (1, 512), (1, 30), (2, 12), (3, 1)])
def test_groups_against_all_pairs(spark, seed, most):
    """Random lines over few words, so that likeness is everywhere and ties abound; leaves that are small, and that go through rounds."""
    rng = random.Random(seed)
    lines = {" ".join(["a", "b", "c", *(rng.choice(["p", "q", "r", "s", line_templates.ANY]) for _ in range(4 + seed))]): rng.randint(1, 3) for _ in range(70)}
    frame = spark.createDataFrame([(5, n, x) for x, n in lines.items()], "leaf long, docs long, masked string")
    for agreement, least in ((0.6, 5), (0.9, 8)):
        got = {r.masked: r.root for r in line_templates._groups(frame, 3, agreement, least, most).collect()}
        assert got == _grouped(lines, 3, agreement, least, most) and (got or agreement > 0.6)


def test_fields_at_any_place_in_a_large_leaf(spark, monkeypatch):
    """The same through rounds: forty templates, a leaf of 300 lines that is read line by line only when 20 are left."""
    rng = random.Random(8)
    word = lambda size=6: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(size))
    vocabulary, lines = [word() for _ in range(70)], []
    for _ in range(40):
        form = ["could", "not", "open", *(rng.choice(vocabulary) for _ in range(6))]
        for _ in range(7):
            own = list(form)
            own[rng.randrange(3, 9)] = word(9)
            lines.append((len(lines), " ".join(own)))
    groups = line_templates._groups
    monkeypatch.setattr(line_templates, "_groups", lambda *args: groups(*args, 20))
    got = line_templates.drop_templates(spark.createDataFrame(lines, "doc_id long, text string")).collect()
    assert [r.n_dropped for r in got] == [1] * 280


def test_size_estimates_do_not_grow_with_the_rounds(spark):
    """Lines of which none is like another, so that each round has one leader only: the estimate of a join is the product of its sides', and had four times the digits after each round."""
    frame = spark.createDataFrame([(5, 1, f"a b c the {w}") for w in "defghi"], "leaf long, docs long, masked string")
    found = line_templates._groups(frame, 3, 0.6, 5, 1)
    assert found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 2000
    assert found.collect() == []
