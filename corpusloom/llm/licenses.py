"""Licence statements, found by a trained classifier of paragraphs and confirmed against templates."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm._common import bytes_of, chunks, ship, table

#: Sentences of each family, in the words of the licences' own notices and, where those are short, of the whole texts.
TEMPLATES = {
    "apache": (
        "licensed under the apache license version 2.0 the license", "you may not use this file except in compliance with the license", "you may obtain a copy of the license at http www.apache.org licenses license 2.0",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
        "see the license for the specific language governing permissions and limitations under the license",
        "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form",
        "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable patent license to make have made use offer to sell sell import and otherwise transfer the work",
        "you must give any other recipients of the work or derivative works a copy of this license", "you must cause any modified files to carry prominent notices stating that you changed the files",
        "you must retain in the source form of any derivative works that you distribute all copyright patent trademark and attribution notices from the source form of the work",
    ),
    "mit": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
        "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits",
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
        "use of this source code is governed by a bsd style license",
    ),
    "gpl": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        "you should have received a copy of the gnu general public license along with this program", "see the gnu general public license for more details",
    ),
    "lgpl": (
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
        "you should have received a copy of the gnu lesser general public license along with this library", "see the gnu lesser general public license for more details",
    ),
    "agpl": (
        "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation",
        "you should have received a copy of the gnu affero general public license along with this program", "see the gnu affero general public license for more details",
    ),
    "mpl": (
        "this source code form is subject to the terms of the mozilla public license v. 2.0", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla.org mpl 2.0",
        "covered software is provided under this license on an as is basis without warranty of any kind either expressed implied or statutory", "each contributor hereby grants you a world wide royalty free non exclusive license under intellectual property rights to use reproduce make available modify display perform distribute and otherwise exploit its contributions",
    ),
    "epl": (
        "this program and the accompanying materials are made available under the terms of the eclipse public license v. 2.0", "the accompanying materials are made available under the eclipse public license which is available at http www.eclipse.org legal epl 2.0",
    ),
    "unlicense": (
        "this is free and unencumbered software released into the public domain",
        "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
        "in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain",
    ),
    "cc": (
        "this work is licensed under a creative commons attribution 4.0 international license", "to view a copy of this license visit http creativecommons.org licenses by 4.0",
        "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
        "you are free to share copy and redistribute the material in any medium or format", "you must give appropriate credit provide a link to the license and indicate if changes were made",
    ),
}
#: How each family is named, SPDX identifiers among them.
NAMES = {
    "apache": ("apache", "apache 2.0", "apache version 2.0", "apache software license", "asl 2.0"),
    "mit": ("mit", "mit x11", "expat mit", "mit open source"),
    "isc": ("isc", "internet systems consortium"),
    "bsd": ("bsd", "bsd 2 clause", "bsd 3 clause", "new bsd", "simplified bsd", "bsd style", "0bsd"),
    "gpl": ("gnu general public license", "gnu gpl", "gpl", "gpl 2.0", "gpl 3.0 only", "gpl 2 or later", "gplv3", "gplv2"),
    "lgpl": ("gnu lesser general public license", "gnu library general public license", "gnu lgpl", "lgpl", "lgpl 2.1", "lgpl 3.0 only", "lgpl 2.1 or later"),
    "agpl": ("gnu affero general public license", "gnu agpl", "agpl", "agpl 3.0", "agplv3", "affero gpl", "agpl 3.0 only"),
    "mpl": ("mozilla public license", "mozilla public license 2.0", "mpl 2.0", "mpl 1.1", "mpl"),
    "epl": ("eclipse public license", "eclipse public license 2.0", "epl 2.0", "epl 1.0", "epl"),
    "unlicense": ("unlicense",),
    "cc": ("cc by 4.0", "cc by sa 4.0", "cc by nc 4.0", "cc by nc sa 3.0", "cc by nd 4.0", "cc by nc nd 4.0", "creative commons", "creative commons attribution", "creative commons attribution noncommercial 4.0 international", "creative commons attribution sharealike 3.0", "cc0", "cc0 1.0", "creative commons zero"),
}
#: Names that mean something else where no word of licences is near.
_COMMON = {"apache", "mit", "isc", "bsd", "bsd style", "creative commons", "internet systems consortium", "unlicense", "epl", "mpl"}
#: How a statement is worded, {} being a name.
_SAID = (
    "licensed under the {}", "licensed under {}", "released under the {} license", "distributed under the terms of the {} license", "available under the {}", "this work is licensed under the {} license",
    "this software is released under the {}", "the code is licensed under {}", "this document is made available under the {} license", "provided under the terms of the {}", "spdx license identifier {}", "license {}", "{} license",
    "{} licensed", "is {} licensed", "the license is {}", "under {} license", "published under the {} license and open source", "see the {} license for details", "you may use it under the {} license", "its use is subject to the {}",
    "open sourced under {}", "terms of the {} license apply", "all code here is {}", "it is {} see the file license", "sous license {}", "sous {}", "unter der {} license", "unter {}", "bajo la license {}", "bajo {}", "con license {}", "sotto license {}",
)
#: How two are.
_BOTH = ("dual licensed under {} or {}", "licensed under either of {} or {} at your option", "{} or {} license", "under both the {} license and the {} license", "spdx license identifier {} or {}", "the code is {} and the docs are {} licensed", "code {} data {} license", "you may choose {} or {}", "{} and {}")
#: How one without a name of these families is.
_NAMELESS = ("{} license", "{} public license", "{} license version 1.0", "{} open license 2.0", "{} community license", "{} software license", "{} license agreement", "{} source license 1.1", "{} {} license")
#: Sentences with words of licences that state none.
_OTHER = (
    "he lost his driving license", "the license plate was stolen", "she is a licensed nurse", "the public works department", "the mit campus is large", "the apache tribe lived in the plains", "a free copy of the book",
    "software version 2.0 was released", "the work is under way", "general public opinion", "the source code is large", "permission is needed to enter", "use of the form is free of charge", "released under pressure", "the terms of the contract",
    "this work is about the public", "the file is subject to change", "version 3", "the creative process", "under the common law", "you may not use the lift", "it is the law of the land", "this is the end of the story", "any person may attend", "and or the other",
    "the solar eclipse was seen by the public", "the library is open to the general public", "copyright law is old", "in no event was he late", "the author was liable for damages", "a fee is charged for any purpose",
    "a fishing license costs ten dollars", "the pilot holds a commercial license", "apache helicopters flew over the town", "students at mit built a robot", "the general spoke to the public", "the public library closes at six",
    "version 2.0 of the plan was subject to review", "they distributed copies of the notice to all", "free software is a matter of liberty", "the terms were agreed in writing", "creative people in the commons", "an eclipse is rare", "the software is slow", "either way the author lost",
    "permission was granted to leave", "the warranty of the car is void", "he works for the foundation", "under the bridge", "binary forms and source texts", "charge the battery", "the liability of the owner is limited by law", "redistribution of wealth was a condition of the deal",
    "she waived her rights to the house", "all rights reserved", "copyright 2014 by the author", "notices must be posted at the door", "mit der bahn nach hause", "er kommt mit", "unter der brucke", "sous la pluie", "bajo el sol", "the mozilla browser crashed", "the board licensed two taxi firms",
    "the agency may modify or revoke permission at any time", "a license to print money", "the bar lost its liquor license", "the merchant sold goods fit for a purpose", "use copy and paste", "mit and other schools", "the work may be published in the form of a book", "you can redistribute the chairs", "by the terms of the will",
    "a marriage license was issued by the county", "the hunting license is valid for a year", "television license fees rose again", "the shop sells beer under a license of the city", "poetic license", "license fees were the main revenue of the firm", "licensed premises must close at midnight",
    "the broadcaster lost its license last year", "her medical license was renewed", "the taxi license and the trade license expired", "he forgot his license at home", "the union said that its general terms were open to the public", "an export license is required for arms", "the drug was licensed to another company",
    "the license of the bank was withdrawn", "apache is the name of a people", "bsd stands for a university system", "mit is a school", "eclipse of the moon", "mozilla is a foundation", "commons are land that all may use", "the source of the river", "the open is a tournament", "he got a license to fly and a license to sail",
)
#: Words of statements that also stand alone, in other languages too.
_STRAY = ("mit", "by", "des mit", "mit und", "mit der", "by the", "free", "public", "general", "open", "version", "license", "work", "software", "apache", "source", "sa", "nc", "4.0", "2.0", "3", "is licensed", "the terms", "under the", "expat", "creative", "commons", "is mit", "simplified", "new", "only", "the eclipse", "eclipse", "later", "library", "isc", "sous", "bajo", "unter", "con", "bsd", "mozilla")
#: Frequent words of plain prose in the languages of the corpus, "mit" and "sous" among them.
_PROSE = "the of and to in is that for it with as on by this be at are from or an not have der die das und mit ist zu den von ein nicht les des et la le sous est dans une que los las el por con bajo en un se".split()
UNKNOWN = "unknown"
FAMILIES = (*TEMPLATES,)
_RELATIVES = ("gpl", "lgpl", "agpl")
#: Families that calibration holds out together, relatives with each other.
_APART = (_RELATIVES, ("mit", "isc", "unlicense"), ("bsd", "cc", "epl"), ("apache", "mpl"))
#: A family is confirmed if so much of the word pairs of a template or a name of it is in a paragraph, and not of another's that fits better.
CONFIRM = 0.6
#: Paragraphs of more word parts are judged in windows of as many, each beginning half a window after the last.
WINDOW = 64
#: Words for licence in the languages of the corpus.
_LICENCE = {"licence", "licences", "licenses", "lizenz", "licencia", "licenza", "licença"}
_OWN = {"license", "licence", "licensed", "gnu", "gpl", "lgpl", "agpl", "mozilla", "spdx", "cc", "bsd", "mpl", "epl", "gplv3", "gplv2", "agplv3", "cc0", "unlicense", "affero", "isc"}
_SIGNS = b"\"'()[]{}<>*_.,;:!?-%$#"
_PART = re.compile(r"\d+(?:\.\d+)*|[^\W\d_]+")


def parts(word: str) -> list[str]:
    """The words that a word is made of: letters and numbers apart, without a v before a number."""
    found = _PART.findall(word.lower())
    out = []
    for i, p in enumerate(found):
        if i + 1 < len(found) and found[i + 1][0].isdigit() and p[-1] == "v" and p + found[i + 1] in word.lower():
            p = p[:-1]
        out.append("license" if p in _LICENCE else p)
    return [p.removesuffix(".0") if p[0].isdigit() else p for p in out if p]


def tokens(text: str) -> list[str]:
    return [p for w in text.split() for p in parts(w)]


def _invented(rng: np.random.Generator) -> str:
    return "".join("bdklmnrstv"[rng.integers(10)] + "aeiou"[rng.integers(5)] for _ in range(rng.integers(2, 5)))


def examples(seed: int = 11) -> list[tuple[list[str], frozenset[str], int]]:
    """Paragraphs, the families they state (``unknown``: a licence of none of them; none: no licence), and their fold.

    Those made of the same sentence, or of the same wording of a statement, are of one fold.
    """
    rng = np.random.default_rng(seed)
    common = sorted({w for s in _OTHER for w in tokens(s)} - {"license", "licensed", "mit", "apache", "bsd", "mozilla"})
    invent = lambda: _invented(rng)
    pick = lambda xs: xs[rng.integers(len(xs))]
    word = lambda: invent() if rng.random() < 0.5 else pick(common)
    out: list[tuple[list[str], frozenset[str], int]] = []

    def add(text: str, families: set[str], fold: int, most: int = 12) -> None:
        """With some words around it, as a paragraph has them."""
        around = [[word() for _ in range(int(rng.integers(0, most)))] if rng.random() < 0.6 else [] for _ in range(2)]
        out.append(([*around[0], *tokens(text), *around[1]], frozenset(families), fold % len(_APART)))

    for f, notice in TEMPLATES.items():
        for i, sentence in enumerate(notice):
            words = sentence.split()
            for _ in range(6):
                add(" ".join(w for w in words if rng.random() > 0.08), {f}, i)
            for at in range(0, len(words) - 8, 7):  # parts, as windows give them
                add(" ".join(words[at : at + 16]), {f}, i)
            add(" ".join(notice[i : i + 2]), {f}, i)
        add(" ".join(notice), {f}, 0, 4)
    for f, names in NAMES.items():
        for i, said in enumerate(_SAID):
            for name in names:
                if name not in _COMMON or "licens" in said or "open source" in said:
                    for _ in range(2):
                        add(said.format(name), {f}, i)
    for i, said in enumerate(_BOTH):
        for _ in range(60):
            f, g = rng.choice(FAMILIES, 2, replace=False)
            a, b = (pick(NAMES[x]) for x in (f, g))
            if "licens" in said or not {a, b} & _COMMON:
                add(said.format(a, b), {str(f), str(g)}, i)
    for i, said in enumerate(s for s in _SAID if "{}" in s):
        for tail in _NAMELESS:
            add(said.removesuffix(" license").format(tail.format(invent(), invent())), {UNKNOWN}, i)
    for i, s in enumerate(_OTHER):
        for _ in range(8):
            add(s, set(), i, 24)
        others = [pick(_OTHER) for _ in range(3)]
        out.append((tokens(" ".join([s, *others])), frozenset(), i % len(_APART)))
    for i, w in enumerate(_STRAY):
        for most in (1, 2, 3, 6, 12, 30):
            add(w, set(), i, most)
    for i in range(1200):  # plain prose, at any density of frequent words
        n, share = int(rng.integers(1, WINDOW + 1)), rng.random()
        few = [pick(_PROSE) for _ in range(int(rng.integers(1, 12)))]
        marks = 0.5 * rng.random() * (i % 3 == 0)  # numbers and letters, as identifiers fall into
        out.append(([pick(few) if rng.random() < share else pick("0123456789abcdef") if rng.random() < marks else invent() for _ in range(n)], frozenset(), i % len(_APART)))
    vocabulary = sorted({w for ts in TEMPLATES.values() for t in ts for w in tokens(t)} - _OWN)
    for i in range(900):
        n = int(rng.integers(1, WINDOW))
        out.append(([pick(vocabulary) if rng.random() < 0.3 else word() for _ in range(n)], frozenset(), i % len(_APART)))
    return out


class LicenceModel:
    """A logistic regression for each family on single words and word pairs of a paragraph, and one for any licence.

    A paragraph may state several families, or a licence of none of them. Models without a quarter of the sentences and of the
    wordings, and without some families altogether, are asked for what they haven't seen: that calibrates
    the probabilities and sets the one below which a family isn't believed.
    """

    def __init__(self, rounds: int = 100, decay: float = 2e-4):
        data = examples()
        self.words = {w: i + 1 for i, w in enumerate(sorted({w for s in (*_PROSE, *_OTHER, *_STRAY, *_SAID, *_BOTH, *_NAMELESS, *(x for f in FAMILIES for x in (*TEMPLATES[f], *NAMES[f]))) for w in tokens(s)}))}
        self.size = len(self.words) + 1  # 0 is any other word
        rows = [np.array([self.words.get(w, 0) for w in t], np.int64) for t, _, _ in data]
        seen, often = np.unique(np.concatenate([r[:-1] * self.size + r[1:] for r, (_, f, _) in zip(rows, data, strict=True) if f]), return_counts=True)
        self.pairs = seen[(often > 1) & (seen > 0)]
        self.weights = np.zeros((self.size + len(self.pairs) + 1, len(FAMILIES) + 1), np.float32)
        x = np.zeros((len(data), len(self.weights)), np.float32)
        for i, ids in enumerate(rows):
            x[i, self.features(ids)] = 1
        truth = np.array([[g in f for g in FAMILIES] + [bool(f)] for _, f, _ in data], np.float32)
        fold = np.array([k for *_, k in data])
        z, strange = np.zeros_like(truth), np.zeros(len(data), np.float32)
        for k, apart in enumerate(_APART):
            of = truth[:, [FAMILIES.index(f) for f in apart]].any(axis=1)
            own = self._fit(x, truth, (fold != k) & ~of, rounds, decay)
            there = (fold == k) & ~of
            z[there] = x[there] @ own
            strange[of] = (x[of] @ own)[:, :-1].max(axis=1)
        within = np.zeros(len(data), bool)
        for k, apart in enumerate(_APART):
            within |= (fold == k) & ~truth[:, [FAMILIES.index(f) for f in apart]].any(axis=1)
        self.weights = self._fit(x, truth, np.ones(len(data), bool), rounds, decay)
        # one line for all families, one for any licence: log odds as they turn out on what hasn't been seen
        for heads in (slice(0, len(FAMILIES)), slice(len(FAMILIES), None)):
            slope, shift = _line(z[within, heads].ravel(), truth[within, heads].ravel())
            self.weights[:, heads] *= slope
            self.weights[-1, heads] += shift
            z[:, heads] = z[:, heads] * slope + shift
            if heads.start == 0:
                strange = strange * slope + shift
        p = _odds(z)
        #: (foretold, found) of the family probabilities in ten steps, on what hasn't been seen.
        steps = np.digitize(p[within, :-1].ravel(), np.linspace(0.1, 0.9, 9))
        self.reliability = [(float(p[within, :-1].ravel()[steps == s].mean()), float(truth[within, :-1].ravel()[steps == s].mean())) for s in range(10) if (steps == s).sum() > 20]
        stated = p[within, :-1][truth[within, :-1] > 0]
        foreign = _odds(strange[truth[:, :-1].any(axis=1)])
        cuts = np.linspace(0.5, 0.98, 49)
        #: A family below this probability is believed only if a template confirms it, an unknown licence isn't: keeps most of the statements
        #: not seen, and turns away most of the families not seen.
        self.cut = float(cuts[int(np.argmax([(stated >= c).mean() + (foreign < c).mean() for c in cuts]))])
        self.kept, self.turned_away = float((stated >= self.cut).mean()), float((foreign < self.cut).mean())
        said = {f: [x for n in NAMES[f] for x in ((f"{n} license", f"{n} licensed", f"license {n}") if n in _COMMON else (n,))] for f in FAMILIES}
        self.proofs = [(f, Counter(zip(t, t[1:], strict=False)) if len(t) > 1 else Counter(t)) for f in FAMILIES for s in (*TEMPLATES[f], *said[f]) for t in [tokens(s)]]
        #: Word pair or single word -> the proofs that have it, and how often.
        self.holding: dict = {}
        for i, (_, proof) in enumerate(self.proofs):
            for key, n in proof.items():
                self.holding.setdefault(key, []).append((i, n))

    def _fit(self, x: np.ndarray, truth: np.ndarray, use: np.ndarray, rounds: int, decay: float) -> np.ndarray:
        x, truth = x[use], truth[use]
        weights = np.zeros((x.shape[1], truth.shape[1]), np.float32)
        weights[-1] = -3
        moment, speed = np.zeros_like(weights), np.zeros_like(weights)
        for step in range(1, rounds + 1):
            g = x.T @ (_odds(x @ weights) - truth) / len(x) + decay * weights
            moment, speed = 0.9 * moment + 0.1 * g, 0.99 * speed + 0.01 * g * g
            weights -= 0.1 * (moment / (1 - 0.9**step)) / (np.sqrt(speed / (1 - 0.99**step)) + 1e-6)
        return weights

    def features(self, ids: np.ndarray) -> np.ndarray:
        """Numbers of the words and pairs that occur in a paragraph, and of the constant."""
        both = np.unique(ids[:-1] * self.size + ids[1:])
        at = np.minimum(np.searchsorted(self.pairs, both), len(self.pairs) - 1)
        return np.concatenate([np.unique(ids[ids > 0]), self.size + at[self.pairs[at] == both], [len(self.weights) - 1]])

    def rate(self, words: list[str]) -> np.ndarray:
        """Probabilities of the families and, last, of any licence, for the words of a window."""
        return _odds(self.weights[self.features(np.array([self.words.get(w, 0) for w in words], np.int64))].sum(axis=0))

    def confirmed(self, words: list[str]) -> set[str]:
        """The families of which a template or name is in the words. The best fits come first, of equals the longest, and take their pairs along."""
        left, single = Counter(zip(words, words[1:], strict=False)), Counter(words)
        out: set[str] = set()
        hits = Counter()
        for key, n in (*left.items(), *single.items()):
            for i, m in self.holding.get(key, ()):
                hits[i] += min(n, m)
        open_ = [i for i, n in hits.items() if n >= CONFIRM * self.proofs[i][1].total()]
        while open_:
            fits = []
            for i in open_:
                family, proof = self.proofs[i]
                n = sum(min(m, (left if type(k) is tuple else single)[k]) for k, m in proof.items())
                if n >= CONFIRM * proof.total():
                    fits.append((n == proof.total(), n, n / proof.total(), family, i))
            if not fits:
                break
            *_, family, best = max(fits)
            out.add(family)
            proof = self.proofs[best][1]
            if type(next(iter(proof))) is tuple:
                taken = left & proof
                left = left - proof
                for a, b in taken:
                    single.subtract({a: 1, b: 1})
                single = +single
            else:
                single = single - proof
            open_ = [i for *_, i in fits]
        return out

    def judge(self, p: np.ndarray, words: list[str]) -> dict[str, tuple[float, bool]]:
        """family -> (probability, confirmed) of a window with these probabilities."""
        sure = self.confirmed(words) if p.max() >= 0.5 else set()
        found = {f: (float(q), f in sure) for f, q in zip(FAMILIES, p, strict=False) if q >= self.cut or (q >= 0.5 and f in sure)}
        if any(found[f][1] for f in found if f in _RELATIVES):  # they share words: next to a confirmed one, others need to be confirmed
            found = {f: v for f, v in found.items() if v[1] or f not in _RELATIVES}
        return found or ({UNKNOWN: (float(p[-1]), False)} if p[-1] >= self.cut else {})


def _odds(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _line(z: np.ndarray, truth: np.ndarray) -> tuple[float, float]:
    """Slope and shift that turn z into the log odds of truth, by Newton's method."""
    x, w = np.stack([z, np.ones_like(z)], axis=1).astype(float), np.array([1.0, 0.0])
    for _ in range(20):
        p = _odds(x @ w)
        w -= np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - truth))
    return float(max(w[0], 0.1)), float(w[1])


@cache
def trained() -> LicenceModel:
    """The model, trained once a driver."""
    return LicenceModel()


class _Ids(dict):
    """Raw word -> a number for each of its parts: its id, whether it begins a raw word, whether it ends a paragraph; remembers the words met last."""

    LIMIT = 1 << 18

    def __init__(self, words: dict[str, int]):
        super().__init__()
        self.words = words
        self.plain = {w.encode(): (i * 4 + 2,) for w, i in words.items()} | {w.encode(): (words["license"] * 4 + 2,) for w in _LICENCE}

    def __missing__(self, raw: bytes) -> tuple[int, ...]:
        if len(self) >= self.LIMIT:
            self.clear()
        core = raw.strip(_SIGNS)
        if core.isalpha():  # ASCII letters only, by far the most: one part
            out = self[raw] = self.plain.get(core.lower(), (2,))
            return out
        ids = [0] if raw == b"\0" else [self.words.get(p, 0) for p in parts(raw.decode("utf-8", "replace"))] or [-1]  # signs only: no word
        out = self[raw] = tuple(i * 4 + 2 * (n == 0) + (raw == b"\0") for n, i in enumerate(ids))
        return out


_FOUND = "array<struct<paragraph:int,family:string,probability:double,confirmed:boolean,text:string>>"
#: A line that goes on in lower case after one that doesn't end a sentence is of the same paragraph.
_WRAPPED = re.compile(rb"(?<=[^\s.!?:;])[ \t\r]*\n[ \t]*(?=[a-z])")


def paragraphs(text: bytes) -> list[bytes]:
    """The lines of a text, wrapped ones joined."""
    return _WRAPPED.sub(b" ", text.replace(b"\0", b" ")).split(b"\n")


def windows(n: int) -> list[tuple[int, int]]:
    """Where a paragraph of n word parts is judged."""
    if n <= WINDOW:
        return [(0, n)]
    return [(a, a + WINDOW) for a in range(0, n - WINDOW, WINDOW // 2)] + [(n - WINDOW, n)]


def _promising(model: LicenceModel, ids: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which windows can reach even odds for anything: a bound that adds the gains of words and pairs, none of the losses, for each
    family, as often as they occur. Windows that fall short of it are not looked at; none of them could be found."""
    gain = np.maximum(model.weights, 0)
    gain[0] = 0
    both = ids[:-1] * model.size + ids[1:]
    at = np.minimum(np.searchsorted(model.pairs, both), len(model.pairs) - 1)
    pair = np.flatnonzero(model.pairs[at] == both)
    known = np.flatnonzero(ids)
    best = np.zeros((len(begin), gain.shape[1]))
    for where, what, stop in ((known, ids[known], end), (pair, model.size + at[pair], np.maximum(end - 1, begin))):
        total = np.concatenate([np.zeros((1, gain.shape[1])), np.cumsum(gain[what], axis=0, dtype=np.float64)])
        best += total[np.searchsorted(where, stop)] - total[np.searchsorted(where, begin)]
    return np.flatnonzero((end > begin) & (best + model.weights[-1] > -1e-3).any(axis=1))


def _scan(model: LicenceModel, keep: list[str]):
    kind = pa.list_(pa.struct([("paragraph", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("confirmed", pa.bool_()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = _Ids(model.words)
        for batch in chunks(batches):
            words: list[list[bytes]] = [b" \0 ".join(paragraphs(t)).split() + [b"\0"] if t else [b"\0"] for t in bytes_of(batch.column("text"))]
            flat = [w for ws in words for w in ws]
            raw = np.array([x for w in flat for x in ids_of[w]], np.int64)
            word = np.cumsum(raw >> 1 & 1) - 1  # which raw word a part is of
            kept = (raw >> 2) >= 0
            raw, word = raw[kept], word[kept]
            ids, stop = raw >> 2, np.flatnonzero(raw & 1)  # paragraphs end before their mark
            start = np.concatenate([[0], stop[:-1] + 1])
            long = stop - start > WINDOW
            spans = [(start[~long], stop[~long], np.flatnonzero(~long))]
            for i in np.flatnonzero(long).tolist():
                at = np.array(windows(int(stop[i] - start[i]))) + start[i]
                spans.append((at[:, 0], at[:, 1], np.full(len(at), i)))
            begin, end, number = (np.concatenate(c) for c in zip(*spans, strict=True))
            first = np.cumsum([0, *map(len, words)])[:-1]  # raw words before each text
            last = np.searchsorted(word[stop], first)  # paragraphs before each text
            found: list[dict[tuple[int, str], dict]] = [{} for _ in words]
            for w in _promising(model, ids, begin, end).tolist():
                a, b, i = int(begin[w]), int(end[w]), int(number[w])
                p = _odds(model.weights[model.features(ids[a:b])].sum(axis=0))
                if p.max() < 0.5:
                    continue
                text = b" ".join(flat[word[a] : word[b - 1] + 1]).decode("utf-8", "replace")
                r = int(np.searchsorted(last, i, "right")) - 1
                for family, (probability, sure) in model.judge(p, _words_of(flat, word, a, b)).items():
                    key = (i - int(last[r]), family)
                    old = found[r].get(key)
                    # the surest window of a family speaks for its paragraph
                    if old is None or (sure, probability) > (old["confirmed"], old["probability"]):
                        found[r][key] = {"paragraph": key[0], "family": family, "probability": probability, "confirmed": sure, "text": text}
            counts = np.diff(np.append(last, len(stop)))
            named = [{k[0] for k in f if k[1] != UNKNOWN} for f in found]
            rows = [sorted((v for k, v in f.items() if k[1] != UNKNOWN or k[0] not in some), key=lambda v: (v["paragraph"], v["family"])) for f, some in zip(found, named, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(counts, pa.int64()), pa.array(rows, kind)], [*keep, "n_paragraphs", "found"])

    return run


def _words_of(flat: list[bytes], word: np.ndarray, a: int, b: int) -> list[str]:
    """The word parts a to b; a window may begin or end within a raw word."""
    first, last = int(word[a]), int(word[b - 1])
    skip = a - int(np.searchsorted(word, first))
    all_ = [p for w in flat[first : last + 1] for p in parts(w.decode("utf-8", "replace"))]
    return all_[skip : skip + b - a]


def scan(docs: DataFrame, model: LicenceModel | None = None) -> DataFrame:
    """Licence statements of each text: doc_id, n_paragraphs, found (paragraph, family, probability, confirmed, text).

    Paragraphs are lines; a line that goes on in lower case after one that ends no sentence is of the same paragraph. Each is
    classified whole, one of more than 64 word parts in overlapping windows, so that prose doesn't drown a statement in it;
    text is the paragraph or its surest window. A paragraph can state several families. One that states a licence
    but no family, as neither a template confirms one nor the calibrated probability is reached, is ``unknown``. No shuffle.

    Edge cases: null and empty texts have one empty paragraph and nothing found. Repeated rows are judged
    alike. Other columns are not read.
    """
    ship(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_scan(model or trained(), ["doc_id"]), f"doc_id {dict(docs.dtypes)['doc_id']}, n_paragraphs long, found {_FOUND}")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    families = F.array_sort(F.array_distinct(F.transform("found", lambda x: x["family"])))
    sure = F.array_sort(F.array_distinct(F.transform(F.filter("found", lambda x: x["confirmed"]), lambda x: x["family"])))
    return found.select("doc_id", "n_paragraphs", F.size("found").cast("long").alias("n_statements"), F.array_join(families, ",").alias("families"), F.array_join(sure, ",").alias("confirmed_families"), F.array_max(F.transform("found", lambda x: x["probability"])).alias("top_probability"))
