"""License scans: sparse TF-IDF cosine to license templates, then inheritance from the nearest directory above.

A text is weighed in units: each of its lines; each paragraph of several lines (between blank lines), so that wrapped notices and
header blocks count as one; and each run of several paragraphs that all have one of SECTION_WORDS, as license texts do. Templates are
the titles of licenses, notices, the headers that licenses ask for, whole texts of the short licenses, and SPDX lines. A unit's words (runs of letters and
digits in lower case) are weighted by their frequency in the unit and by ln((1 + texts) / (1 + texts with the word)) + 1, counted
over all words of all texts. A unit's license is the template with the greatest cosine, at LEAST or more (at LEAST_SHORT for those of up to SHORT words, at
LEAST_SPDX for SPDX lines, which differ in the name alone), among those whose distinguishing words the unit has: of a name, and of a
version; a template isn't taken where a word stands that tells a license of the same family (lesser, affero, noncommercial ...). A text's
license is that of its best unit (of equals runs, then paragraphs, then lines; then the first unit; then the first license by name).

Units are weighed only if they hold a telling word: those that are left of a template when its words that most texts have go, as long
as these together weigh less than LEAST of it. Without one of them no unit can reach that cosine, so nothing is lost. Equal texts are weighed
once.

A text whose license unit holds at least half of its words, or whose name says so (LICENSE, LICENCE, COPYING), is a license
file: it holds for its directory. A file without a license of its own inherits that of the nearest directory above that has one (the
lowest path of several). Directories are resolved first, once each; the files then join their directory.

Null texts have no units. A null path is a file without directory: it inherits nothing. Repeated rows are judged each. Other
columns pass through `scan`, nulls included; columns of the results' names are replaced, names that begin with _lic_ are its own.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, nonnull, stored, table

LEAST, LEAST_SHORT, LEAST_SPDX, SHORT = 0.5, 0.6, 0.9, 10
#: What the paragraphs of a license say, one or the other.
SECTION_WORDS = "licence license licensed licensee licensor copyright software warranty warranties liability redistribution redistributions redistribute permission contributor contributors derivative disclaimer endorse".split()
# What licenses and notices of them say.
_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_AS_IS = "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD_TWO = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THREE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_END = "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} Public License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."
_GNU_END = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} Public License for more details. You should have received a copy of the GNU {0} Public License along with this program. If not, see https://www.gnu.org/licenses/."
_GNU_KINDS = (("GPL-2.0", "General", "2"), ("GPL-3.0", "General", "3"), ("LGPL-2.1", "Lesser General", "2.1"), ("LGPL-3.0", "Lesser General", "3"), ("AGPL-3.0", "Affero General", "3"))
_APACHE = "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
_APACHE_END = "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
_UNLICENSE = "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
_ZLIB = "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
_CC_KINDS = (("CC-BY-4.0", "Attribution"), ("CC-BY-NC-4.0", "Attribution NonCommercial"), ("CC-BY-SA-4.0", "Attribution ShareAlike"), ("CC-BY-ND-4.0", "Attribution NoDerivatives"))
_TEXTS = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"), ("Apache-2.0", _APACHE), ("Apache-2.0", _APACHE + " " + _APACHE_END), ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("BSD-2-Clause", _BSD_TWO), ("BSD-2-Clause", "BSD 2-Clause License " + _BSD_TWO + " " + _BSD_END),
    ("BSD-3-Clause", _BSD_TWO + " " + _BSD_THREE), ("BSD-3-Clause", "BSD 3-Clause License " + _BSD_TWO + " " + _BSD_THREE + " " + _BSD_END), ("BSD-3-Clause", _BSD_THREE),
    ("CC0-1.0", "To the extent possible under law the author has waived all copyright and dedicated this work to the public domain CC0 1.0 Universal"),
    ("ISC", _ISC), ("ISC", "ISC License " + _ISC + " " + _ISC_END),
    ("MIT", "Released under the MIT License"), ("MIT", "The MIT License (MIT)"), ("MIT", _GRANT), ("MIT", "MIT License " + _GRANT + " " + _AS_IS),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"), ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Proprietary", "All rights reserved"), ("Unlicense", "This is free and unencumbered software released into the public domain"), ("Unlicense", _UNLICENSE), ("Zlib", _ZLIB),
)
_NOTICES = "This work is licensed under the GNU {0} Public License, version {1}"
_SPDX = "0BSD AGPL-3.0 Apache-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-SA-4.0 CC-BY-ND-4.0 CC0-1.0 EPL-2.0 GPL-2.0 GPL-3.0 ISC LGPL-2.1 LGPL-3.0 MIT MPL-2.0 Unlicense Zlib".split()
# Titles, as the licenses' own texts and notices of them write them.
_TITLES = (
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"), ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"), ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"), ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"), ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("EPL-2.0", "Eclipse Public License - v 2.0"), ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"), ("CC0-1.0", "CC0 1.0 Universal"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International"), ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International"), ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International"),
    ("CC-BY-ND-4.0", "Creative Commons Attribution-NoDerivatives 4.0 International"), ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-3-Clause", "BSD 3-Clause License"), ("ISC", "ISC License"), ("Unlicense", "The Unlicense"), ("Zlib", "zlib License"),
)
_PROJECTS = (
    ("MIT", "MIT License"), ("Apache-2.0", "Apache License 2.0"), ("GPL-2.0", "GNU General Public License v2.0"), ("GPL-3.0", "GNU General Public License v3.0"), ("LGPL-2.1", "GNU Lesser General Public License v2.1"),
    ("LGPL-3.0", "GNU Lesser General Public License v3.0"), ("AGPL-3.0", "GNU Affero General Public License v3.0"), ("MPL-2.0", "Mozilla Public License 2.0"), ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-3-Clause", "BSD 3-Clause License"),
    ("ISC", "ISC License"), ("EPL-2.0", "Eclipse Public License 2.0"), ("BSL-1.0", "Boost Software License 1.0"),
)
# Words that a unit must have (one of each group) for a short template of the license, and words that it mustn't have.
_MUST = {
    "AGPL-3.0": "affero agpl agplv3, 3 v3 agplv3", "Apache-2.0": "apache, 2 v2", "BSD-2-Clause": "bsd, 2", "BSD-3-Clause": "bsd, 3", "BSL-1.0": "boost bsl", "CC0-1.0": "cc0", "EPL-2.0": "eclipse epl, 2 v2", "GPL-2.0": "gnu gpl gplv2, 2 v2 gplv2",
    "GPL-3.0": "gnu gpl gplv3, 3 v3 gplv3", "ISC": "isc", "LGPL-2.1": "lesser lgpl lgplv2, 2 v2 lgplv2, 1", "LGPL-3.0": "lesser lgpl lgplv3, 3 v3 lgplv3", "MIT": "mit, license licence licensed", "MPL-2.0": "mozilla mpl, 2 v2", "Proprietary": "rights, reserved, all",
    "Unlicense": "unlicense unencumbered", "Zlib": "zlib", "0BSD": "0bsd", "CC-BY-4.0": "cc creative, by attribution, 4", "CC-BY-SA-4.0": "cc creative, sa sharealike, 4", "CC-BY-NC-4.0": "cc creative, nc noncommercial, 4", "CC-BY-ND-4.0": "cc creative, nd noderivatives, 4",
}
_NOT = {"GPL-2.0": "lesser lgpl affero agpl 3 v3", "GPL-3.0": "lesser lgpl affero agpl", "CC-BY-4.0": "nc noncommercial sa sharealike nd noderivatives", "BSD-2-Clause": "3 endorse", "Apache-2.0": "mit"}

#: (license, text, least cosine)
TEMPLATES = tuple(
    (name, text, max(least, LEAST_SHORT) if len(text.split()) <= SHORT else least)
    for found, least in (
        (_TEXTS, LEAST),
        ([(n, t.format(kind, v)) for n, kind, v in _GNU_KINDS for t in (_GNU, _GNU + " " + _GNU_END, _NOTICES)], LEAST),
        ([(n, t) for n, kind in _CC_KINDS for t in (f"This work is licensed under a Creative Commons {kind} 4.0 International License", f"Licensed under {n.replace('CC-', 'CC ').replace('-4.0', ' 4.0')}")], LEAST),
        (_TITLES, LEAST),
        ([(n, t.format(name)) for n, name in _PROJECTS for t in ("This project is licensed under the {0} - see the LICENSE file for details", "Licensed under the {0}")], LEAST),
        ([(n, f"{verb} under {n}{end}") for n in _SPDX for end in (("", "-only", "-or-later") if "GPL" in n else ("",)) for verb in ("Distributed", "Licensed")], LEAST),
        ([(n.removesuffix(end), f"SPDX-License-Identifier: {n}{end}") for n in _SPDX for end in (("", "-only", "-or-later") if "GPL" in n else ("",))], LEAST_SPDX),
    )
    for name, text in found
)


def marks(name: str, text: str) -> tuple[list[frozenset[str]], frozenset[str]]:
    """The groups of words of which a unit must have one each for this template, and the words that it mustn't have.

    Of the groups those count that the template itself meets: whole texts needn't name their license."""
    own = {*re.findall(r"[a-z0-9]+", text.lower())}
    groups = [frozenset(g.split()) for g in _MUST.get(name, "").split(",") if g.strip()]
    if len(own) > 30 and name.startswith("BSD"):
        groups = [frozenset({"endorse"})] if "endorse" in own else []
    return [g for g in groups if g & own], frozenset(_NOT.get(name, "").split()) - own


_BREAK = "[^a-z0-9]+"
_FILE = r"(?i)(^|/)(licen[cs]e|copying)[^/]*$"
_BLANK = r"\n[ \t\r]*\n"
#: Stand before a paragraph of a run, and for any other; a text that has them itself is cut there too, or its words stay apart.
_JOINT, _CUT = "\x02", "\x01"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(nonnull(text)), _BREAK, -1), "")


def document_frequencies(docs: DataFrame) -> DataFrame:
    """term, df: of every word, over all texts."""
    return docs.select(F.explode(F.array_distinct(words(F.col("text")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def _idf(df: Column, n: int) -> Column:
    return F.log((F.lit(1.0) + n) / (1 + df)) + 1


def template_weights(frequencies: DataFrame, n: int, given: tuple[tuple[str, str, float], ...] = TEMPLATES) -> tuple[DataFrame, list[str]]:
    """(license, form, least, term, w: the term's share of the unit vector, mark: a bit for the group of words that it is of, never, marks: how many groups there are), and the telling words. As many as the templates have."""
    spark = frequencies.sparkSession
    counts = [Counter(re.findall(r"[a-z0-9]+", text.lower())) for _, text, _ in given]
    asked = spark.createDataFrame([(t,) for t in sorted(set().union(*counts))], "term string")
    seen = {r["term"]: r["df"] for r in frequencies.join(F.broadcast(asked), "term").collect()}
    unit, telling = [], set()
    for form, ((name, text, least), tf) in enumerate(zip(given, counts, strict=True)):
        w = {t: c * (math.log((1 + n) / (1 + seen.get(t, 0))) + 1) for t, c in tf.items()}
        norm, light = sum(v * v for v in w.values()), 0.0
        must, never = marks(name, text)
        group = {t: 1 << i for i, g in enumerate(must) for t in g}
        # words that only mark weigh nothing
        unit += [(name, form, least, t, w.get(t, 0.0) / math.sqrt(norm), group.get(t, 0), t in never, len(must)) for t in sorted({*w, *group, *never})]
        for t in sorted(w, key=lambda t: (-seen.get(t, 0), t)):
            light += w[t] * w[t]
            if light >= 0.999 * least * least * norm:
                telling.add(t)
    return spark.createDataFrame(unit, "license string, form int, least double, term string, w double, mark int, never boolean, marks int"), sorted(telling)


def units(texts: DataFrame, telling: list[str]) -> DataFrame:
    """texts: a, b, text. a, b, n_all, kind (0 a run of paragraphs, 1 a paragraph, 2 a line), at, words: the units with a telling word."""
    some = F.array(*map(F.lit, telling))
    legal = F.array(*map(F.lit, SECTION_WORDS))
    made = lambda kind: lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("at"), words(x).alias("words"))
    every = F.split("text", _BLANK, -1)
    # what isn't of a license becomes a mark at which the rest is cut
    cut = F.array_join(F.transform(every, lambda p: F.when(F.arrays_overlap(words(p), legal), F.concat(F.lit(_JOINT), p)).otherwise(F.lit(_CUT))), "")
    runs = F.filter(F.split(cut, _CUT, -1), lambda r: F.length(r) - F.length(F.replace(r, F.lit(_JOINT), F.lit(""))) >= 2)
    paragraphs = F.filter(every, lambda x: x.contains("\n"))
    all_ = F.concat(F.transform(runs, made(0)), F.transform(paragraphs, made(1)), F.transform(F.split("text", "\n", -1), made(2)))
    found = texts.select("a", "b", F.size(words(F.col("text"))).alias("n_all"), F.explode(F.filter(all_, lambda u: F.arrays_overlap(u["words"], some))).alias("u"))
    return found.select("a", "b", "n_all", "u.kind", "u.at", "u.words")


def own_licenses(docs: DataFrame, given: tuple[tuple[str, str, float], ...] = TEMPLATES) -> DataFrame:
    """docs: text. a, b (two hashes of the text), own_license, score, mostly: of the texts with a license unit."""
    frequencies, n = stored(document_frequencies(docs), "frequencies"), docs.count()
    unit, telling = template_weights(frequencies, n, given)
    marked = docs.select("text").where(F.arrays_overlap(words(F.col("text")), F.array(*map(F.lit, telling)))).select(*_hashes(), "text").dropDuplicates(["a", "b"])
    key = ["a", "b", "n_all", "kind", "at", "n"]
    terms = units(marked, telling).select("a", "b", "n_all", "kind", "at", F.size("words").alias("n"), F.explode("words").alias("term"))
    terms = stored(terms.groupBy(*key, "term").agg(F.count(F.lit(1)).alias("tf")), "terms")
    asked = stored(frequencies.join(bounded(terms.select("term").distinct()), "term", "left_semi"), "asked")
    v = stored(terms.join(bounded(asked), "term").select(*key, "term", (F.col("tf") * _idf(F.col("df"), n)).alias("v")), "weighted")
    norms = v.groupBy(*key).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    dots = v.join(F.broadcast(unit), "term").groupBy(*key, "license", "form", "least", "marks").agg(F.sum(F.col("v") * F.col("w")).alias("dot"), F.bool_or("never").alias("never"), F.bit_or("mark").alias("met"))
    told = dots.where(~F.col("never") & (F.bit_count("met") == F.col("marks")))
    least = told.join(norms, key).withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("cosine") >= F.col("least"))
    best = least.groupBy("a", "b", "n_all").agg(F.min(F.struct((-F.col("cosine")).alias("score"), "kind", "at", "license", "n")).alias("x"))
    return best.select("a", "b", F.col("x.license").alias("own_license"), (-F.col("x.score")).alias("score"), (F.col("x.n") * 2 >= F.col("n_all")).alias("mostly"))


def _hashes() -> list[Column]:
    return [F.xxhash64("text").alias("a"), F.xxhash64("text", F.lit(1)).alias("b")]


def directory(path: Column) -> Column:
    """The path's directory; the top one is the empty string."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def inherited(files: DataFrame) -> DataFrame:
    """files: path, own_license, mostly. dir, license: for every directory the license of the nearest license file at it or above."""
    holders = files.where(F.col("own_license").isNotNull() & F.col("path").isNotNull() & (F.col("mostly") | F.col("path").rlike(_FILE)))
    holds = holders.groupBy(directory(F.col("path")).alias("above")).agg(F.min_by("own_license", F.struct("path", "own_license")).alias("license"))
    dirs = files.where("path IS NOT NULL").select(directory(F.col("path")).alias("dir")).distinct()
    parts = F.split("dir", "/", -1)
    depths = F.when(F.col("dir") == "", F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.size(parts)))
    steps = dirs.select("dir", F.explode(depths).alias("depth")).withColumn("above", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/"))
    return steps.join(holds, "above").groupBy("dir").agg(F.max_by("license", "depth").alias("license"))


def scan(files: DataFrame) -> DataFrame:
    """files: path, text. files with own_license, score, license and inherited."""
    names = ("own_license", "score", "license", "inherited")
    kept = [c for c in files.columns if c not in names]
    own = stored(own_licenses(files.select("text")), "licenses")
    some = files.select("path", *_hashes()).join(bounded(own), ["a", "b"])
    by_dir = inherited(files.select("path", F.lit(None).cast("string").alias("own_license"), F.lit(False).alias("mostly")).unionByName(some.select("path", "own_license", "mostly")))
    own = own.select(F.col("a").alias("_lic_a"), F.col("b").alias("_lic_b"), F.col("own_license").alias("_lic_own"), F.col("score").alias("_lic_score"))
    by_dir = by_dir.select(F.col("dir").alias("_lic_dir"), F.col("license").alias("_lic_above"))
    done = files.select(*kept).withColumns({"_lic_a": F.xxhash64("text"), "_lic_b": F.xxhash64("text", F.lit(1))}).join(bounded(own), ["_lic_a", "_lic_b"], "left")
    done = done.withColumn("_lic_dir", F.when(F.col("path").isNotNull(), directory(F.col("path")))).join(bounded(by_dir), "_lic_dir", "left")
    mine, above = F.col("_lic_own"), F.col("_lic_above")
    return done.select(*kept, mine.alias("own_license"), F.coalesce("_lic_score", F.lit(0.0)).alias("score"), F.coalesce(mine, above).alias("license"), (mine.isNull() & above.isNotNull()).alias("inherited"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as files in nested directories: source/lang/a/b/doc_id.txt, b and a being the last digits of the id."""
    id_ = F.col("doc_id")
    path = F.concat("source", F.lit("/"), "lang", F.lit("/"), F.floor(id_ / 10) % 10, F.lit("/"), id_ % 10, F.lit("/"), "doc_id", F.lit(".txt"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", path.alias("path"))
    return scan(docs).select("doc_id", "path", "own_license", "score", "license", "inherited")


def _given() -> str:
    rows = []
    for form, (name, text, least) in enumerate(TEMPLATES):
        must, never = marks(name, text)
        lists = "[" + ", ".join("[" + ", ".join(f"'{t}'" for t in sorted(g)) + "]" for g in must) + "]::VARCHAR[][]"
        rows.append(f"('{name}', {form}, {least}, '{text}', {lists}, [{', '.join(repr(t) for t in sorted(never))}]::VARCHAR[])")
    return ", ".join(rows)


_WORDS = "regexp_extract_all(lower({0}), '[a-z0-9]+')"
_LEGAL = "[" + ", ".join(f"'{t}'" for t in SECTION_WORDS) + "]"
_UNITS = f"""SELECT r, 2 AS kind, k, string_split(text, chr(10))[k] AS s FROM (SELECT r, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS k FROM d)
  UNION ALL SELECT r, 1, k, p[k] FROM (SELECT r, p, unnest(range(1, len(p) + 1)) AS k FROM (SELECT r, list_filter(string_split_regex(text, '{_BLANK}'), lambda x: contains(x, chr(10))) AS p FROM d))
  UNION ALL SELECT r, 0, k, p[k] FROM (SELECT r, p, unnest(range(1, len(p) + 1)) AS k FROM (SELECT r, list_filter(string_split(array_to_string(list_transform(string_split_regex(text, '{_BLANK}'),
    lambda x: CASE WHEN list_has_any({_WORDS.format("x")}, {_LEGAL}) THEN chr(2) || x ELSE chr(1) END), ''), chr(1)), lambda y: length(y) - length(replace(y, chr(2), '')) >= 2) AS p FROM d))"""
SQL = f"""
WITH d AS (SELECT *, len({_WORDS.format("text")}) AS n_all FROM (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
  source || '/' || lang || '/' || (doc_id // 10) % 10 || '/' || doc_id % 10 AS dir FROM documents)),
g AS (SELECT * FROM (VALUES {_given()}) AS v(license, form, least, text, must, never)),
t AS (SELECT license, form, least, term, count(*) AS tf FROM (SELECT license, form, least, unnest({_WORDS.format("text")}) AS term FROM g) GROUP BY ALL),
n AS (SELECT count(*) AS n FROM d),
f AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT r, unnest({_WORDS.format("text")}) AS term FROM d) GROUP BY term),
u AS (SELECT license, form, least, term, v / sqrt(sum(v * v) OVER (PARTITION BY form)) AS w FROM (SELECT t.*, tf * (ln((1 + n) / (1 + coalesce(df, 0))) + 1) AS v FROM t CROSS JOIN n LEFT JOIN f USING (term))),
l AS (SELECT r, kind, k, {_WORDS.format("s")} AS ws FROM ({_UNITS})),
z AS (SELECT * FROM l WHERE list_has_any(ws, (SELECT list(DISTINCT term) FROM t))),
v AS (SELECT r, kind, k, n_unit, term, count(*) AS tf FROM (SELECT r, kind, k, len(ws) AS n_unit, unnest(ws) AS term FROM z) GROUP BY ALL),
x AS (SELECT r, kind, k, n_unit, term, tf * (ln((1 + n) / (1 + df)) + 1) AS v FROM v CROSS JOIN n JOIN f USING (term)),
q AS (SELECT r, kind, k, sqrt(sum(v * v)) AS norm FROM x GROUP BY ALL),
c AS (SELECT r, kind, k, n_unit, license, form, least, round(sum(v * w) / any_value(norm), 6) AS cosine FROM x JOIN u USING (term) JOIN q USING (r, kind, k) GROUP BY r, kind, k, n_unit, license, form, least),
m AS (SELECT c.* FROM c JOIN g USING (form) JOIN z USING (r, kind, k) WHERE c.cosine >= c.least AND NOT list_has_any(z.ws, g.never) AND len(list_filter(g.must, lambda a: NOT list_has_any(z.ws, a))) = 0),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY cosine DESC, kind, k, license) AS o FROM m) WHERE o = 1),
o AS (SELECT d.*, dir || '/' || doc_id || '.txt' AS path, license AS own_license, coalesce(cosine, 0) AS score, coalesce(n_unit * 2 >= n_all, false) AS mostly FROM d LEFT JOIN b USING (r)),
h AS (SELECT dir AS above, arg_min(own_license, path) AS license FROM o WHERE own_license IS NOT NULL AND mostly GROUP BY dir),
s AS (SELECT dir, k, array_to_string(list_slice(string_split(dir, '/'), 1, k), '/') AS above FROM (SELECT dir, unnest(range(0, len(string_split(dir, '/')) + 1)) AS k FROM (SELECT DISTINCT dir FROM d))),
i AS (SELECT dir, arg_max(license, k) AS license FROM s JOIN h USING (above) GROUP BY dir)
SELECT doc_id, path, own_license, score::DOUBLE AS score, coalesce(own_license, i.license) AS license, own_license IS NULL AND i.license IS NOT NULL AS inherited
FROM o LEFT JOIN i USING (dir)
"""
