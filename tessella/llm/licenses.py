"""License scans by template-markup matching.

A template is wording with optional regions, `[[ ... ]]`, and replaceable ones, `{{min,max}}` (that many words of any
kind). It is compiled into a token automaton; a place of a text is accepted if the automaton runs through from there, so
all mandatory wording must stand exactly as given. The automaton is started only at places where its longest mandatory
run begins to fit. The work is a map over Arrow batches without a shuffle; templates are fixed values of a few KB.

Base labels come from short phrases whose words stand consecutively.

Defined results: null and empty texts have no words, no labels, null first_word and last_word and a score of 0; repeated
rows get the same result each; texts of any length are matched whole; other columns are passed through; an empty table
gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm._common import table, values, words_of

# Phrases and their labels.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

# Wording of public licences, with optional and replaceable regions marked.
MIT_GRANT = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation "
    "files the software to deal in the software without restriction including without limitation the rights to use copy modify "
    "merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is "
    "furnished to do so subject to the following conditions"
)
MIT_WARRANTY = (
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties "
    "of merchantability fitness for a particular purpose and {{1,3}} in no event shall {{2,8}} be liable for any claim damages or "
    "other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or "
    "the use or other dealings in the software"
)
BSD_HEAD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
    "conditions are met [[ {{1,1}} ]] redistributions of source code must retain the above copyright notice this list of conditions "
    "and the following disclaimer [[ {{1,1}} ]] redistributions in binary form must reproduce the above copyright notice this list of "
    "conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
)
BSD_TAIL = (
    "this software is provided by {{1,12}} as is and any express or implied warranties including but not limited to the implied "
    "warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {{1,12}} be liable for any "
    "direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute "
    "goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in "
    "contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if "
    "advised of the possibility of such damage"
)
GNU_HEAD = (
    "{{1,6}} is free software you can redistribute it and or modify it under the terms of the gnu"
)
GNU_TAIL = "or at your option any later version"
TEMPLATES = {
    "apache-2.0-header": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the "
    "license you may obtain a copy of the license at [[ {{1,8}} ]] unless required by applicable law or agreed to in writing software "
    "distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or "
    "implied see the license for the specific language governing permissions and limitations under the license",
    "apache-2.0-notice": "licensed under the apache license version 2 0",
    "cc-by-notice": "licensed under [[ a ]] [[ the ]] [[ creative commons attribution ]] cc by [[ {{1,2}} ]] [[ license ]]",
    "gpl-notice": "licensed under the gnu [[ lesser ]] [[ affero ]] general public license [[ version {{1,2}} ]]",
    "gpl-2.0-or-later": f"{GNU_HEAD} general public license as published by the free software foundation either version 2 [[ of the license ]] {GNU_TAIL}",
    "gpl-3.0-or-later": f"{GNU_HEAD} general public license as published by the free software foundation either version 3 [[ of the license ]] {GNU_TAIL}",
    "lgpl-2.1-or-later": f"{GNU_HEAD} lesser general public license as published by the free software foundation either version 2 1 [[ of the license ]] {GNU_TAIL}",
    "agpl-3.0-or-later": f"{GNU_HEAD} affero general public license as published by the free software foundation either version 3 [[ of the license ]] {GNU_TAIL}",
    "mpl-2.0-header": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed "
    "with this file you can obtain one at",
    "mit": f"{MIT_GRANT} the above copyright notice and this permission notice [[ including the next paragraph ]] shall be included in all copies "
    f"or substantial portions of the software {MIT_WARRANTY}",
    "mit-0": f"{MIT_GRANT.removesuffix(' subject to the following conditions')} {MIT_WARRANTY}",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of {{1,6}} and associated "
    "documentation files [[ the software ]] to deal in the software without restriction",
    "mit-notice": "[[ released ]] [[ licensed ]] under the mit license",
    "isc": "permission to use copy modify and [[ or ]] distribute this software for any purpose with or without fee is hereby granted provided "
    "that the above copyright notice and this permission notice appear in all copies the software is provided as is and {{1,6}} disclaims "
    "all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall {{1,6}} be "
    "liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
    "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of "
    "this software",
    "bsd-2-clause": f"{BSD_HEAD} {BSD_TAIL}",
    "bsd-3-clause": f"{BSD_HEAD} [[ {{{{1,1}}}} ]] neither the name of {{{{1,12}}}} nor the names of {{{{1,3}}}} contributors may be used to endorse or "
    f"promote products derived from this software without specific prior written permission {BSD_TAIL}",
    "bsd-terms": "redistribution and use in source and binary forms with or without modification are permitted provided "
    "that the following conditions are met",
    "zlib": "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages "
    "arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial "
    "applications and to alter it and redistribute it freely subject to the following restrictions [[ {{1,1}} ]] the origin of this software "
    "must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an "
    "acknowledgment in the product documentation would be appreciated but is not required [[ {{1,1}} ]] altered source versions must be plainly "
    "marked as such and must not be misrepresented as being the original software [[ {{1,1}} ]] this notice may not be removed or altered from "
    "any source distribution",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell "
    "or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "reserved-notice": "copyright [[ c ]] {{0,8}} all rights reserved",
}


class Automaton:
    """States 0..n over words: at state i, `words[i]` is the word that leads to i + 1; `skips[i]` are states that i also
    stands for; `anything[i]` says that any word leads to i + 1."""

    def __init__(self, template: str):
        tokens = re.findall(r"\[\[|\]\]|\{\{\d+,\d+\}\}|[^\s\[\]{}]+", template)
        self.words: list[bytes | None] = []
        self.anything: list[bool] = []
        self.skips: dict[int, list[int]] = {}
        opened: list[int] = []
        runs: list[tuple[int, list[bytes]]] = [(0, [])]
        for t in tokens:
            if t == "[[":
                opened.append(len(self.words))
                runs.append((-1, []))
            elif t == "]]":
                self.skips.setdefault(opened.pop(), []).append(len(self.words))
                runs.append((len(self.words), []))
            elif t.startswith("{{"):
                low, high = map(int, t[2:-2].split(","))
                start = len(self.words)
                self.words += [None] * high
                self.anything += [True] * high
                for i in range(low, high):
                    self.skips.setdefault(start + i, []).append(start + high)
                runs.append((-1 if opened else len(self.words), []))
            else:
                self.words.append(t.encode())
                self.anything.append(False)
                if not opened:
                    runs[-1][1].append(t.encode())
        self.end = len(self.words)
        #: The longest run of words that every accepted place holds, and the words at most before it.
        self.reach, longest = max(((at, r) for at, r in runs if at >= 0), key=lambda x: len(x[1]))
        self.anchor = b" " + b" ".join(longest) + b" "

    def closed(self, states: set[int]) -> set[int]:
        stack, out = list(states), set(states)
        while stack:
            for j in self.skips.get(stack.pop(), ()):
                if j not in out:
                    out.add(j)
                    stack.append(j)
        return out

    def run(self, words: list[bytes], at: int) -> int:
        """The end of the longest accepted place that starts at a word, or -1."""
        states, best, i = self.closed({0}), -1, at
        while states:
            if self.end in states:
                best = i
            if i >= len(words):
                break
            w = words[i]
            states = self.closed({s + 1 for s in states if s < self.end and (self.anything[s] or self.words[s] == w)})
            i += 1
        return best


AUTOMATA = {k: Automaton(v) for k, v in TEMPLATES.items()}


def places(joined: bytes, needle: bytes) -> list[int]:
    """Words at which a phrase starts, in a text of single blanks between and around the words."""
    out, at = [], joined.find(needle)
    word, last = 0, 0
    while at >= 0:
        word += joined.count(b" ", last, at)
        out.append(word)
        last, at = at, joined.find(needle, at + 1)
    return out


def scan(raw: bytes | None) -> dict:
    """Base places and accepted templates of a text."""
    words = words_of(raw)
    joined = b" " + b" ".join(words) + b" "
    base, firsts, labels, spans = [], [], set(), []
    for phrase, label in PHRASES:
        if at := places(joined, b" " + phrase.encode() + b" "):
            base.append(label)
            firsts += at
    for label, a in AUTOMATA.items():
        done = 0
        for anchor in places(joined, a.anchor):
            for start in range(max(done, anchor - a.reach), anchor + 1):
                end = a.run(words, start)
                if end > anchor:
                    labels.add(label)
                    spans.append({"label": label, "start": start, "end": end})
                    done = end
                    break
    covered, upto = 0, 0
    for x in sorted(spans, key=lambda x: x["start"]):
        covered += max(0, x["end"] - max(upto, x["start"]))
        upto = max(upto, x["end"])
    share = min(1.0, (covered + sum(len(p.split()) for p, label in PHRASES if label in base)) / len(words)) if words else 0.0
    score = 0.5 + 0.5 * share if spans else 0.5 * share
    return {
        "n_words": len(words), "n_base": len(firsts), "first_word": min(firsts, default=None), "last_word": max(firsts, default=None),
        "base_labels": sorted({*base}), "labels": sorted({*base} | labels), "spans": spans, "licensed_words": covered, "score": score,
    }


FOUND = (
    "struct<n_words: long, n_base: long, first_word: long, last_word: long, base_labels: array<string>, labels: array<string>, "
    "spans: array<struct<label: string, start: long, end: long>>, licensed_words: long, score: double>"
)


def scan_licenses(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """docs' columns in a struct `row`, and a struct `found`: labels, spans of words with their template, and a score.

    The score is 0 without a match. Half of it says that a template is accepted, the other half is the share of the text's
    words that accepted templates, and a phrase of each label, cover.
    """
    packed = docs.select(F.struct("*").alias("row"), F.col(text).cast("binary").alias("raw"))
    schema = packed.select("row", F.lit(None).cast(FOUND).alias("found")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(schema["found"].dataType)
        for batch in batches:
            found = [scan(x) for x in values(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["row", "found"])

    return packed.mapInArrow(run, schema)


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    x = F.col("found")
    return found.select(
        "row.doc_id", x.n_words.alias("n_words"), x.n_base.alias("n_base"), x.first_word.alias("first_word"),
        x.last_word.alias("last_word"), F.array_join(x.base_labels, ",").alias("base_labels"),
        F.array_join(x.labels, ",").alias("labels"), x.score.alias("score"),
    )
