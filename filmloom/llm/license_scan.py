"""Licence scan: a trained paragraph classifier, confirmed by comparison with licence templates."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filmloom.llm import words as W
from filmloom.llm.paragraph_dedup import line_spans

# Public licence notices and the usual ways to name a licence.
TEMPLATES: dict[str, list[str]] = {
    "mit": [
        "Released under the MIT License", "Licensed under the MIT license", "This project is licensed under the terms of the MIT license",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0", "Released under the Apache License 2.0",
        "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3", "Released under the GNU General Public License version 2",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    ],
    "lgpl": [
        "Licensed under the GNU Lesser General Public License", "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License version 2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ],
    "agpl": [
        "Licensed under the GNU Affero General Public License version 3", "Released under the terms of the GNU Affero General Public License",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    ],
    "bsd": [
        "Released under the BSD 3-Clause License", "Use of this source code is governed by a BSD-style license",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License 2.0"],
    "cc-by": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc0": ["Dedicated to the public domain under CC0 1.0 Universal", "This work is marked with CC0 1.0 Universal"],
    "proprietary": ["All rights reserved. No part of this publication may be reproduced without prior written permission", "Copyright the authors. All rights reserved"],
}
#: Names of the families; with the ways to put them below they make whole lines, and alone they follow an SPDX tag.
NAMES: dict[str, list[str]] = {
    "mit": ["MIT"], "apache-2.0": ["Apache-2.0", "Apache 2.0"], "mpl-2.0": ["MPL-2.0", "Mozilla Public License 2.0"], "bsd": ["BSD-2-Clause", "BSD-3-Clause"],
    "gpl": [f"GPL-{v}{x}" for v in ("2.0", "3.0") for x in ("", "-only", "-or-later")], "lgpl": [f"LGPL-{v}{x}" for v in ("2.0", "2.1", "3.0") for x in ("", "-only", "-or-later")],
    "agpl": [f"AGPL-{v}{x}" for v in ("3.0",) for x in ("", "-only", "-or-later")], "cc0": ["CC0-1.0"],
    **{f"cc-{k}": [f"CC-{k.upper()}-{v}" for v in ("2.0", "2.5", "3.0", "4.0")] for k in ("by", "by-sa", "by-nc")},
}
WHOLE_LINES = ["{} License", "The {} License", "License: {}", "Licence: {}"]
TITLES = {
    "mit": ["The MIT License (MIT)"], "apache-2.0": ["Apache License", "Apache License, Version 2.0", "Version 2.0, January 2004"], "bsd": ["BSD License", "The BSD License"], "cc0": ["CC0 1.0 Universal"],
    "gpl": ["GNU General Public License", "GNU GPL"], "lgpl": ["GNU Lesser General Public License", "GNU LGPL"], "agpl": ["GNU Affero General Public License", "GNU AGPL"], "mpl-2.0": ["Mozilla Public License"],
}
#: Notices of no known family: their names are made up while training.
UNKNOWN_FORMS = [
    "Licensed under the {} License", "Released under the {} Public License, version {}", "This work is licensed under {} {}.0", "Distributed under the terms of the {} licence",
    "This software is provided under the {} community license agreement", "Usage is subject to the {} terms of use",
    "Licensed under {} terms", "Use is governed by the {} agreement", "SPDX-License-Identifier: {}", "Lizenziert unter der {} Lizenz", "Dieses Werk steht unter der {} Lizenz", "Alle Rechte vorbehalten",
    "Sous licence {}", "Publié sous la licence {}", "Tous droits réservés", "Bajo la licencia {}", "Publicado bajo la licencia {}", "Todos los derechos reservados",
]

CLASSES = ["none", "unknown", *TEMPLATES]
PIECE, STEP = 40, 20  # words of a piece of a long line, and words from one piece to the next
SIZES = (1, 2, 3)  # word n-grams
BITS = 16  # of a feature's hash
NEGATIVES = 4000  # lines of the corpus that teach the class none: the bound of the labelled sample
VARIANTS = 60  # training rows per template
LEAST_CONFIDENCE = 0.5
ALONE = 0.9  # confidence from which a piece of three different words or more is a notice whatever its wording
LEAST_SHARE = 0.6  # of a template's trigrams that a piece must hold
JOINED_STEP = 10  # words from one piece of a paragraph of several lines to the next
EPOCHS, RATE, DECAY = 80, 10.0, 1e-4


@dataclass
class Model:
    weights: np.ndarray  # feature, class
    bias: np.ndarray
    temperature: float
    templates: list[list[np.ndarray]]  # per family, trigram hashes of each template
    own: list[np.ndarray]  # per family, trigram hashes that no other family's template has
    notices: np.ndarray  # trigram hashes of all templates and unknown forms


def _features(words: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Last word and hashed feature of every n-gram that stays in its line."""
    at, features = [], []
    for size in SIZES:
        runs = W.grams(words, size)
        whole = np.flatnonzero(line[:len(runs)] == line[size - 1:]) if len(runs) else np.zeros(0, np.int64)
        at.append(whole + size - 1)
        features.append((runs[whole] >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate(at), np.concatenate(features)


def _sets(texts: list[str], size: int = 3) -> list[np.ndarray]:
    part = W.Texts(pa.array(texts, pa.string()))
    starts, ends, first = W.spans(part, W.LETTERED)
    words = W.word_hashes(part, starts, ends)
    return [np.unique(W.grams(words[a:b], min(size, max(1, b - a)))) for a, b in zip(first[:-1], first[1:])]


def _training_rows(lines: list[str]) -> tuple[list[str], np.ndarray]:
    """Templates with words left out or added, made-up licences, and corpus lines that resemble no template."""
    rng = np.random.default_rng(3)
    known = np.unique(np.concatenate([s for family in TEMPLATES.values() for s in _sets(family)]))
    plain = [t for t, s in zip(lines, _sets(lines)) if len(s) and np.isin(s, known).mean() < 0.2] if lines else []
    filler = [w for t in plain[:200] for w in t.split()[:20]] or ["text"]
    rows, labels = list(plain), [0] * len(plain)

    def varied(words: list[str]) -> str:
        kept = [w for w in words if rng.random() > 0.04] or words
        extra = [filler[i] for i in rng.integers(0, len(filler), rng.integers(0, 6))]
        return " ".join([*extra, *kept] if rng.random() < 0.5 else [*kept, *extra])

    letters = list("abcdefghijklmnopqrstuvwxyz")
    for i, name in enumerate(CLASSES):
        for template in TEMPLATES.get(name, []):
            rows += [varied(template.split()) for _ in range(VARIANTS)]
            labels += [i] * VARIANTS
    for form in UNKNOWN_FORMS:
        for _ in range(2 * VARIANTS):
            names = ["".join(rng.choice(letters, rng.integers(3, 9))) for _ in range(form.count("{}"))]
            rows.append(varied(form.format(*names).split()))
            labels.append(1)
    return rows, np.array(labels)


def _matrix(rows: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and value of each entry; a row's counts are divided by the root of their number."""
    part = W.Texts(pa.array(rows, pa.string()))
    starts, ends, first = W.spans(part, W.LETTERED)
    line = W.row_of_each(first)
    at, features = _features(W.word_hashes(part, starts, ends), line)
    of = line[at]
    return of, features, 1 / np.sqrt(np.maximum(1, np.bincount(of, minlength=len(rows))))[of]


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def train(lines: list[str]) -> Model:
    """Logistic regression on a bounded sample; a third of it is held out to calibrate the confidence."""
    rows, labels = _training_rows(lines)
    of, features, values = _matrix(rows)
    used, column = np.unique(features, return_inverse=True)
    held = np.arange(len(rows)) % 3 == 0
    truth = np.eye(len(CLASSES))[labels]
    share = np.where(held, 0.0, 1.0) / np.maximum(1, np.bincount(labels[~held], minlength=len(CLASSES)))[labels]
    share /= share.sum()
    weights, bias = np.zeros((len(used), len(CLASSES))), np.zeros(len(CLASSES))

    def raw() -> np.ndarray:
        return np.stack([np.bincount(of, values * weights[column, c], len(rows)) for c in range(len(CLASSES))], axis=1) + bias

    for _ in range(EPOCHS):
        error = (_softmax(raw()) - truth) * share[:, None]
        for c in range(len(CLASSES)):
            weights[:, c] -= RATE * (np.bincount(column, values * error[of, c], len(used)) + DECAY * weights[:, c])
        bias -= RATE * error.sum(axis=0) / 4
    z = raw()[held]
    losses = {t: -np.log(np.maximum(_softmax(z / t)[np.arange(len(z)), labels[held]], 1e-12)).mean() for t in np.geomspace(0.2, 3, 25)}
    full = np.zeros((1 << BITS, len(CLASSES)), np.float32)
    full[used] = weights
    fixed = [piece for form in UNKNOWN_FORMS for piece in form.split("{}")] + [t for family in TEMPLATES.values() for t in family]
    notices = np.unique(np.concatenate(_sets([t for t in fixed if len(t.split()) >= 3])))
    templates = [_sets(family) for family in TEMPLATES.values()]
    every = [np.unique(np.concatenate(sets)) for sets in templates]
    own = [np.setdiff1d(mine, np.concatenate([s for j, s in enumerate(every) if j != i])) for i, mine in enumerate(every)]
    return Model(full, bias, float(min(losses, key=losses.get)), templates, own, notices)


def _holds(own: np.ndarray, family: int, model: Model) -> bool:
    """Whether a piece's trigrams hold enough of a template of the family, and something that tells it from the others."""
    return max(np.isin(t, own).mean() for t in model.templates[family]) >= LEAST_SHARE and bool(np.isin(model.own[family], own).any())


def _reserved(words: np.ndarray, block: np.ndarray) -> list[int]:
    """Where "All rights reserved" stands with "Copyright" or its sign among the words before it, in one block of lines."""
    phrase, marks = _sets(["all rights reserved"])[0], np.concatenate(_sets(["copyright", "©"], 1))
    marked = np.flatnonzero(np.isin(W.grams(words, 1), marks))
    at = np.flatnonzero(np.isin(W.grams(words, 3), phrase)) if len(marked) else marked
    at = at[block[at] == block[at + 2]]
    before = np.searchsorted(marked, at) - 1
    return [int(i) for i, m in zip(at, before) if m >= 0 and i - marked[m] < PIECE and block[i] == block[marked[m]]]


def _keys() -> dict[bytes, str]:
    """Family by the hashes of the words of a name or a whole line."""
    forms = [(form.format(x), family) for family, names in NAMES.items() for x in names for form in ["{}", *WHOLE_LINES]]
    forms += [(x, family) for family, titles in TITLES.items() for x in titles]
    part = W.Texts(pa.array([x for x, _ in forms], pa.string()))
    starts, ends, first = W.spans(part, W.LETTERED)
    words = W.word_hashes(part, starts, ends)
    return {words[a:b].tobytes(): family for a, b, (_, family) in zip(first[:-1], first[1:], forms)}


def _short_lines(words: np.ndarray, begin: np.ndarray, end: np.ndarray, keys: dict[bytes, str]) -> list[tuple[int, int, str]]:
    """Start, end and licence of the lines that are a family's name or title, or that have an SPDX tag."""
    out = []
    for size in {len(k) // 8 for k in keys}:
        known = np.concatenate([W.grams(np.frombuffer(k, np.uint64), size) for k in keys if len(k) == 8 * size])
        at = begin[end - begin == size]
        if size > 1 and len(at):  # a name of one word says nothing without a tag
            out += [(int(a), int(a) + size, keys[words[a:a + size].tobytes()]) for a in at[np.isin(W.grams(words, size)[at], known)]]
    tag, joints, later = _sets(["SPDX-License-Identifier"])[0], np.concatenate(_sets(["or", "and", "with"], 1)), _sets(["later"], 1)[0]
    for a in np.flatnonzero(np.isin(W.grams(words, 3), tag)):
        stop = int(end[np.searchsorted(begin, a, "right") - 1])
        rest = words[a + 3:stop]
        single = W.grams(rest, 1)
        joint = np.isin(single, joints) & ~np.isin(np.append(single[1:], np.uint64(0)), later)  # "or later" is part of a name
        for i, name in enumerate(np.split(rest, np.flatnonzero(joint))):
            name = name[1:] if i else name
            if len(name):
                out.append((int(a), stop, keys.get(name.tobytes(), "unknown")))
    return out


def _joined(words: np.ndarray, begin: np.ndarray, end: np.ndarray, new: np.ndarray, model: Model) -> list[tuple[int, str]]:
    """Place and family of the templates that stand in blocks of several lines, read as one; ``new``: first line of each."""
    last = np.append(new[1:], len(begin)) - 1
    several = last > new
    a0, b0 = begin[new[several]], end[last[several]]
    if not len(a0):
        return []
    known = np.unique(np.concatenate([t for family in model.templates for t in family]))
    runs = W.grams(words, 3)
    held = np.concatenate([[0], np.cumsum(np.isin(runs, known)), np.zeros(0, np.int64)])
    pieces = 1 + np.maximum(0, -(-(b0 - a0 - PIECE) // JOINED_STEP))
    a = np.repeat(a0, pieces) + JOINED_STEP * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    b = np.minimum(a + PIECE, np.repeat(b0, pieces))
    top = len(held) - 1
    some = held[np.clip(b - 2, a, None).clip(max=top)] - held[a.clip(max=top)] >= 2  # no template has less than three
    out = []
    for i in np.flatnonzero(some):
        own = runs[a[i]:b[i] - 2]
        out += [(int(a[i]), name) for f, name in enumerate(TEMPLATES) if _holds(own, f, model)]
    return out


def judge(texts: W.Texts, model: Model) -> tuple[np.ndarray, list[list[str]]]:
    """Number of paragraphs per row, and the licences found in it: a family, or ``unknown``."""
    starts, ends, first = W.spans(texts, W.LETTERED)
    words = W.word_hashes(texts, starts, ends)
    rows = W.row_of_each(first)
    begin, end = line_spans(texts, starts, first)
    found: list[list[str]] = [[] for _ in range(len(texts))]
    paragraphs = np.bincount(rows[begin], minlength=len(texts)) if len(begin) else np.zeros(len(texts), np.int64)
    if not len(begin):
        return paragraphs, found
    line = np.repeat(np.arange(len(begin)), end - begin)
    at, features = _features(words, line)
    order = np.argsort(at, kind="stable")
    upto = np.searchsorted(at[order], np.arange(len(words) + 1))
    sums = np.concatenate([np.zeros((1, len(CLASSES))), np.cumsum(model.weights[features[order]], axis=0, dtype=np.float64)])[upto]
    pieces = 1 + np.maximum(0, -(-(end - begin - PIECE) // STEP))
    a = np.repeat(begin, pieces) + STEP * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    b = np.minimum(a + PIECE, np.repeat(end, pieces))
    n = np.maximum(1, upto[b] - upto[a])
    z = (sums[b] - sums[a]) / np.sqrt(n)[:, None] + model.bias
    best = z.argmax(axis=1)
    line_no = np.searchsorted(np.flatnonzero(texts.data == 10), starts[begin])
    new = np.flatnonzero((np.diff(rows[begin], prepend=-1) != 0) | (np.diff(line_no, prepend=-2) > 1))
    block = np.repeat(np.arange(len(new)), np.diff(np.append(begin[new], len(words))))
    named = _joined(words, begin, end, new, model)
    whole = set()
    for at, _, name in _short_lines(words, begin, end, _keys()):
        whole.add(line[at])
        if name == "unknown":
            found[rows[at]].append(name)
        else:
            named.append((at, name))
    held = {}
    for at, name in named:
        held.setdefault(block[at], []).extend(model.templates[list(TEMPLATES).index(name)])
    for i in np.flatnonzero(best > 0):
        chances = _softmax(z[i:i + 1] / model.temperature)[0]
        sure = 1 - chances[0]
        if chances[best[i]] < LEAST_CONFIDENCE and sure < ALONE:
            continue
        piece = words[a[i]:b[i]]
        own = W.grams(piece, min(3, len(piece)))
        if best[i] > 1 and _holds(own, best[i] - 2, model):
            named.append((int(a[i]), CLASSES[best[i]]))
        elif line[a[i]] in whole or (block[a[i]] in held and np.isin(own, np.concatenate(held[block[a[i]]])).mean() >= 0.5):
            continue  # part of a notice that has its family
        elif np.isin(own, model.notices).any() or (sure >= ALONE and len(np.unique(piece)) >= 3):
            found[rows[a[i]]].append("unknown")
    licensed = {block[at] for at, _ in named}
    named += [(at, "proprietary") for at in _reserved(words, block) if block[at] not in licensed]
    for at, name in named:
        found[rows[at]].append(name)
    return paragraphs, found


def _scanner(model: Broadcast):
    def scan(batches):
        for batch in batches:
            for start, texts in W.slices(batch.column(1), 1 << 20):
                paragraphs, found = judge(texts, model.value)
                names = [sorted(set(f)) for f in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(texts)), pa.array(paragraphs, pa.int64()), pa.array([[x for x in f if x != "unknown"] for f in names], pa.list_(pa.string())), pa.array(["unknown" in f for f in names])],
                    ["doc_id", "n_paragraphs", "licences", "unknown"],
                )

    return scan


def scan(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_paragraphs``, confirmed ``licences`` in order, and whether an ``unknown`` one was found.

    Each line is a paragraph; longer ones are judged in overlapping pieces of 40 words. Lines up to a blank one are also
    joined, and pieces of them compared with the templates, so that wrapped notices count. The classifier is a
    multinomial logistic regression on hashed word one- to three-grams. It is fitted on variants of the templates, on made-up notices
    (class ``unknown``) and on at most 4000 lines of the corpus (class ``none``), chosen by hash. A family counts if its calibrated
    probability is at least one half (or its lines are joined) and the piece holds 60 % of the trigrams of one of its
    templates, among them one that no other family's has; "Copyright ... All rights reserved" is ``proprietary`` unless its lines
    name a family. Lines that are a family's title, and SPDX tags, are compared as a whole. A piece that fails
    the comparison is ``unknown`` if at least three of its words in a row stand in some notice, or if it has three different words
    and the classifier is sure by 0.9 that it is a notice.

    A null or empty text has no paragraphs. Repeated rows and null ids are rows like any other; other columns are not read. An
    empty table gives an empty table.
    """
    lines = docs.select(F.explode(F.split(F.col("text").cast("string"), "\n")).alias("line")).filter(F.length("line") > 0)
    # Four times the sample by a share of the hashes first: what reaches the driver does not grow with the partitions.
    share = min(1.0, 4 * NEGATIVES / max(1, lines.count()))
    drawn = lines.filter(F.shiftrightunsigned(F.xxhash64("line"), 11) < int(share * (1 << 53))).distinct()
    sample = drawn.orderBy(F.xxhash64("line"), "line").limit(NEGATIVES).collect()
    model = docs.sparkSession.sparkContext.broadcast(train([r["line"] for r in sample]))
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        _scanner(model), "doc_id bigint, n_paragraphs bigint, licences array<string>, unknown boolean"
    )
