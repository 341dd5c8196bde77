"""License scans: license templates with optional and replaceable regions, compiled to token automata."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, LongType, StringType, StructField

from sondage.llm.common import arrow_pass, raw_text

# Phrases of the base scan, as words, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# License wording, whole notices and bodies as well as the short lines that name a license. <<optional>> ...
# <<end>> may be missing, <<var:n>> stands for up to n words of any kind, <<one:a|b>> for one of the given wordings.
_AS_IS = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the <<var:6>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
_BSD_HEAD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<optional>>1<<end>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer <<optional>>2<<end>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_BSD_NAMES = "<<optional>>3<<end>> neither the name of <<var:12>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_BSD_TAIL = "this software is provided by <<var:10>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<var:10>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"


def _gnu(kind: str, version: str) -> str:
    """The notice that stands at the head of a file under a GNU license."""
    terms = f"gnu {kind} license"
    return (f"is free software you can redistribute it and or modify it under the terms of the {terms} as published by the free software foundation <<one:either version {version} of the license or at your option any later version|version {version} of the license>> "
            f"<<var:8>> is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the {terms} for more details")


TEMPLATES = {
    "agpl": "licensed under the <<optional>>terms of the<<end>> gnu affero general public license <<optional>>as published by the free software foundation<<end>> <<optional>>version 3<<end>>",
    "agpl-notice": _gnu("affero general public", "3"),
    "apache-2.0": "<<one:licensed|released|distributed>> under the <<optional>>terms of the<<end>> apache <<optional>>software<<end>> license <<optional>>version<<end>> 2 0",
    "apache-2.0-notice": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at <<one:http|https>> www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "bsd-2-clause": f"{_BSD_HEAD} {_BSD_TAIL}",
    "bsd-3-clause": f"{_BSD_HEAD} {_BSD_NAMES} {_BSD_TAIL}",
    "cc-by-4.0": "licensed under <<one:a|the>> creative commons attribution 4 0 international license",
    "cc-by-nc-4.0": "<<one:licensed|released|available>> under <<optional>>a<<end>> <<one:cc by nc|creative commons attribution noncommercial>> 4 0 <<optional>>international license<<end>>",
    "cc-by-sa-4.0": "licensed under <<one:a|the>> creative commons attribution <<one:sharealike|share alike>> 4 0 international license",
    "gpl-2.0": _gnu("general public", "2"),
    "gpl-3.0": "<<one:this work|this program|this software>> is <<optional>>free software and is<<end>> <<one:licensed|released|distributed>> under the <<optional>>terms of the<<end>> gnu general public license <<optional>>as published by the free software foundation<<end>> <<optional>>either<<end>> version 3",
    "gpl-3.0-notice": _gnu("general public", "3"),
    "isc": "permission to use copy modify and <<optional>>or<<end>> distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and <<var:6>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall <<var:6>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "lgpl-2.1": _gnu("lesser general public", "2 1"),
    "lgpl-3.0": _gnu("lesser general public", "3"),
    "mit": "<<one:released|licensed|available>> under the <<optional>>terms of the<<end>> mit license",
    "mit-text": f"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice <<optional>>including the next paragraph<<end>> shall be included in all copies or substantial portions of the software {_AS_IS}",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at <<one:http|https>> mozilla org mpl 2 0",
    "proprietary": "copyright <<optional>>c<<end>> <<var:6>> all rights reserved",
    "unlicense": f"this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law {_AS_IS}",
}
# Labels that several templates share.
LABEL_OF = {"agpl-notice": "agpl", "apache-2.0-notice": "apache-2.0", "gpl-3.0-notice": "gpl-3.0", "mit-text": "mit"}
# Score of a text by its strongest finding: a whole template, a base phrase, nothing.
SCORE_TEMPLATE, SCORE_PHRASE = 1.0, 0.5

# a word is a run of digits, letters and anything beyond ASCII; A-Z are lower-cased
_WORDS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))

Step = tuple[bytes | None, int]


def pattern(template: str) -> str:
    """A template as a regular expression over words that each end in a space, for engines that have no automata of their own."""
    out = []
    for part in re.findall(r"<<[^>]*>>|[^\s<]+", template):
        if part == "<<optional>>":
            out.append("(?:")
        elif part == "<<end>>":
            out.append(")?")
        elif part.startswith("<<var:"):
            out.append(f"(?:[^ ]+ ){{0,{part[6:-2]}}}")
        elif part.startswith("<<one:"):
            out.append("(?:" + "|".join(c + " " for c in part[6:-2].split("|")) + ")")
        else:
            out.append(part + " ")
    return " " + "".join(out)


class Automaton:
    """States with word steps (None: any word) and free moves; state 0 starts, the last state accepts."""

    def __init__(self, template: str):
        self.steps: list[list[Step]] = [[]]
        self.free: list[list[int]] = [[]]
        parts = re.findall(r"<<[^>]*>>|[^\s<]+", template)
        at, opened = 0, []
        for part in parts:
            if part == "<<optional>>":
                opened.append(at)
            elif part == "<<end>>":
                self.free[opened.pop()].append(at)
            elif part.startswith("<<var:"):
                start = at
                for _ in range(int(part[6:-2])):
                    at = self._word(at, None)
                    self.free[start].append(at)
            elif part.startswith("<<one:"):
                ends = []
                for choice in part[6:-2].split("|"):
                    k = self._state()
                    self.free[at].append(k)
                    for w in choice.split():
                        k = self._word(k, w.encode())
                    ends.append(k)
                at = self._state()
                for k in ends:
                    self.free[k].append(at)
            else:
                at = self._word(at, part.encode())
        self.final = at
        self.anchor = self._anchor(parts)

    def _state(self) -> int:
        self.steps.append([])
        self.free.append([])
        return len(self.steps) - 1

    def _word(self, at: int, word: bytes | None) -> int:
        k = self._state()
        self.steps[at].append((word, k))
        return k

    @staticmethod
    def _anchor(parts: list[str]) -> bytes:
        """The longest run of mandatory words: a text without it cannot be accepted."""
        runs, run, depth = [], [], 0
        for p in parts:
            if p == "<<optional>>":
                depth += 1
            if p.startswith("<<") or depth:
                runs.append(run)
                run = []
            else:
                run.append(p)
            if p == "<<end>>":
                depth -= 1
        return b" " + " ".join(max([*runs, run], key=lambda r: len(" ".join(r)))).encode() + b" "

    def closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for k in self.free[todo.pop()]:
                if k not in states:
                    states.add(k)
                    todo.append(k)
        return states

    def accepts_from(self, words: list[bytes], start: int) -> bool:
        """Whether the mandatory wording stands in the words from ``start`` on."""
        now = self.closed({0})
        for i in range(start, len(words)):
            w = words[i]
            now = self.closed({k for s in now for need, k in self.steps[s] if need is None or need == w})
            if self.final in now:
                return True
            if not now:
                return False
        return False

    def firsts(self) -> set[bytes]:
        return {need for s in self.closed({0}) for need, _ in self.steps[s]}


def scan(raw: bytes, automata: dict[str, Automaton], phrases: dict[str, str] = PHRASES) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score) of a text in UTF-8."""
    words = raw.translate(_WORDS).split()
    flat = b" " + b" ".join(words) + b" "
    places, base = [], set()
    for phrase, label in phrases.items():
        find = b" " + phrase.encode() + b" "
        at, seen, before = flat.find(find), 0, 0
        while at >= 0:
            # words up to a place are counted on from the last one
            before, seen = before + flat.count(b" ", seen, at), at
            places.append(before)
            base.add(label)
            at = flat.find(find, at + 1)
    found = set()
    for name, a in automata.items():
        if LABEL_OF.get(name, name) not in found and a.anchor in flat:
            firsts = a.firsts()
            if any(w in firsts and a.accepts_from(words, i) for i, w in enumerate(words)):
                found.add(LABEL_OF.get(name, name))
    score = SCORE_TEMPLATE if found else SCORE_PHRASE if base else 0.0
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | found)), score


def scan_licenses(docs: DataFrame, text: str = "text", templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """``row`` (the input row) with n_words, n_base, first_word, last_word, base_labels, labels and score.

    Base: all places where a phrase's words stand one after another; first and last are the smallest and largest start
    (words from 0), null without a place. labels holds the base labels and those of the templates that an automaton
    accepts somewhere in the text, distinct, sorted, joined by commas, an empty string for none. score is 1 with a
    template, 0.5 with base phrases only, else 0. Null and empty texts have no words. Whole texts are read; repeated rows
    get equal results; other columns stay inside ``row``.
    """
    fields = [StructField("n_words", LongType()), StructField("n_base", LongType()), StructField("first_word", LongType()), StructField("last_word", LongType()), StructField("base_labels", StringType()), StructField("labels", StringType()), StructField("score", DoubleType())]

    def make():
        automata = {n: Automaton(t) for n, t in templates.items()}

        def fn(arrays):
            got = [scan(t, automata, phrases) for t in arrays[0].to_pylist()]
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            return [pa.array(c, k) for c, k in zip(zip(*got), kinds)] if got else [pa.array([], k) for k in kinds]

        return fn

    return arrow_pass(docs, make, {"raw": raw_text(text)}, fields)
