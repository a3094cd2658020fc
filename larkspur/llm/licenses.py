"""License scans: stretches of a text compared with license templates by the Dice coefficient of their word bigrams.

Text and template are normalised alike: lower case, and everything that is neither letter nor digit is one space. Every run
of words of a document is compared, wherever its lines and paragraphs break. Of the bags of word bigrams A of a run and B of
a template, Dice is 2 |A and B| / (|A| + |B|); THRESHOLD or more is a match. A match needs t / (2 - t) |B| bigrams in common
and |A| <= (2 - t) / t |B|, so a run is looked at only where that many of a template's bigrams lie that close together. A run
that begins or ends with a bigram which isn't the template's is never better than the shorter one, so runs from one shared
bigram to another are all there is to compare. Before that, documents are left out that have none of the templates' anchors:
words of a template without all of which too few of its bigrams are left for any match (see `anchors`). Only shared bigrams
leave a row's place: they are met with the templates' by a broadcast of bounded size, and dealt out by row and template. All
of it is DataFrame functions.

Of each row and template the best run is returned (of equal ones the first, then the shortest), with the number of separate
regions that overlapping matches form. Templates that match alike are all reported. Null and empty texts match nothing, nor
does a text of one word. Rows repeated under one doc_id, or under a null one, are rows of their own. An empty table gives an
empty result. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

THRESHOLD = 0.8
#: Bytes of template bigrams that are broadcast; with more, they are joined by shuffles.
BROADCAST_BYTES = 8 << 20

# Published notices and licence texts.
_WARRANTY_MIT = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_WARRANTY_BSD = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
TEMPLATES = [
    ("Apache-2.0-line", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-4.0-line", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0-line", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0-line", "Licensed under CC BY-SA 4.0."),
    ("GPL-2.0-line", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-line", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT-line", "Released under the MIT License."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("Apache-2.0-header", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD-2-Clause", f"{_BSD} {_WARRANTY_BSD}"),
    ("BSD-3-Clause", f"{_BSD} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_WARRANTY_BSD}"),
    ("GPL-3.0-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. ' + _WARRANTY_MIT),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
]


def normalised(text: str) -> str:
    return re.sub(r"[\W_]+", " ", text.lower()).strip()


def bigrams(text: str) -> Counter[str]:
    words = normalised(text).split()
    return Counter(f"{a} {b}" for a, b in zip(words, words[1:]))


def bounds(size: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """(least, most) bigrams of a run that can match a template with this many; it shares the least at least."""
    return math.ceil(round(size * threshold / (2 - threshold), 9)), math.floor(round(size * (2 - threshold) / threshold, 9))


def anchors(own: Counter[str], threshold: float = THRESHOLD, templates: list[tuple[str, str]] = TEMPLATES) -> set[str]:
    """Words of which a run that matches a template with these bigrams has at least one.

    The anchors are in more of the template's bigrams than a match can lack. Long words come first, then words of few
    templates, as they are rare in other texts.
    """
    spare = own.total() - bounds(own.total(), threshold)[0]
    chosen: set[str] = set()
    common = Counter(w for _, text in templates for w in set(normalised(text).split()))
    for word in sorted({w for b in own for w in b.split()}, key=lambda w: (-len(w), common[w], w)):
        if sum(n for b, n in own.items() if chosen & set(b.split())) > spare:
            break
        chosen.add(word)
    return chosen


def _words(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " ")


def _bigrams(words: Column) -> Column:
    rest = F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))
    head = F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0)))
    return F.zip_with(head, rest, lambda a, b: F.concat(a, F.lit(" "), b))


def hits(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(row, doc_id, license, size, least, most, pos, g, c): where rows have a template's bigram g, which it has c times."""
    owned = [(name, own) for name, text in templates if (own := bigrams(text))]
    if len({name for name, _ in owned}) < len(owned):
        raise ValueError("templates have different names")
    listed = [(g, name, c, own.total(), *bounds(own.total(), threshold)) for name, own in owned for g, c in own.items()]
    table = docs.sparkSession.createDataFrame(listed, "g string, license string, c int, size int, least int, most int")
    if sum(len(g) + len(name) + 40 for g, name, *_ in listed) <= BROADCAST_BYTES:
        table = F.broadcast(table)
    known = sorted(set().union(*(anchors(own, threshold, templates) for _, own in owned)))
    words = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), _words(F.col("text")).alias("words"))
    likely = words.where(F.arrays_overlap("words", F.array(*map(F.lit, known)))) if known else words.limit(0)
    return likely.select("row", "doc_id", F.posexplode(_bigrams(F.col("words"))).alias("pos", "g")).join(table, "g")


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, license, dice, start_word, n_words, n_regions): by row and template, the best run and how many regions match."""
    key = ["row", "license"]
    met = hits(docs, templates, threshold).repartition(*key)
    # what comes before a bigram by as many of its kind as the template has: a run from there on has one too many
    times = sorted({c for _, text in templates for c in bigrams(text).values()})
    same, back = Window.partitionBy(*key, "g").orderBy("pos"), F.lit(None).cast("int")
    for c in times:
        back = F.when(F.col("c") == c, F.lag("pos", c).over(same)).otherwise(back)
    enough = met.withColumn("n", F.count("*").over(Window.partitionBy(*key))).where("n >= least").withColumn("back", F.coalesce(back, F.lit(-1)))
    rows = enough.groupBy(*key, "doc_id", "size", "least", "most").agg(F.sort_array(F.collect_list(F.struct("pos", "back"))).alias("at"))
    at, size, least, most = F.col("at"), F.col("size"), F.col("least"), F.col("most")
    # hits with enough others after them, as close as a match allows
    places = F.filter(F.sequence(F.lit(1), F.size(at) - least + 1), lambda k: F.get(at, k + least - 2).pos - F.get(at, k - 1).pos < most)

    def best(k: Column) -> Column:
        """The best run that begins at the k-th hit: its Dice, its first and last bigram."""
        first = F.get(at, k - 1).pos
        none = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("dice"), first.alias("last"))

        def add(run: Column, x: Column) -> Column:
            n = run.n + (x.back < first).cast("int")
            dice = 2.0 * n / (x.pos - first + 1 + size)
            better = (dice > run.dice) & (x.pos - first < most)
            return F.struct(n.alias("n"), F.when(better, dice).otherwise(run.dice).alias("dice"), F.when(better, x.pos).otherwise(run.last).alias("last"))

        return F.aggregate(F.slice(at, k, most), none, add, lambda run: F.struct(run.dice.alias("dice"), first.alias("first"), run.last.alias("last")))

    found = rows.select("doc_id", "license", F.filter(F.transform(places, best), lambda x: x.dice >= threshold).alias("runs")).where(F.size("runs") > 0)
    none = F.struct(F.lit(0).alias("n"), F.lit(-1).alias("end"), F.lit(0.0).alias("dice"), F.lit(0).alias("first"), F.lit(0).alias("last"))

    def merge(s: Column, x: Column) -> Column:
        pick = lambda name: F.when(x.dice > s.dice, x[name]).otherwise(s[name]).alias(name)
        return F.struct((s.n + (x["first"] > s.end).cast("int")).alias("n"), F.greatest(s.end, x["last"]).alias("end"), pick("dice"), pick("first"), pick("last"))

    whole = found.select("doc_id", "license", F.aggregate("runs", none, merge).alias("s"))
    return whole.select(
        "doc_id", "license", F.round("s.dice", 9).alias("dice"), F.col("s.first").cast("long").alias("start_word"),
        (F.col("s.last") - F.col("s.first") + 2).cast("long").alias("n_words"), F.col("s.n").cast("long").alias("n_regions"),
    )


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def oracle(templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same scan in SQL, over every two shared bigrams that are close enough, without anchors."""
    rows = ", ".join(f"({_quoted(g)}, {_quoted(name)}, {c}, {own.total()})" for name, text in templates if (own := bigrams(text)) for g, c in own.items())
    return rf"""
WITH templates(g, license, c, size) AS (VALUES {rows}),
words AS (SELECT doc_id, string_split(trim(regexp_replace(lower("text"), '[^\pL\pN]+', ' ', 'g')), ' ') AS w FROM documents WHERE "text" IS NOT NULL),
places AS (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM words),
grams AS (SELECT doc_id, i - 1 AS pos, w[i] || ' ' || w[i + 1] AS g FROM places),
hits AS (SELECT doc_id, license, size, pos, g, c, row_number() OVER (PARTITION BY doc_id, license, g ORDER BY pos) AS k FROM grams JOIN templates USING (g)),
backed AS (SELECT a.doc_id, a.license, a.size, a.pos, coalesce(b.pos, -1) AS back FROM hits a
  LEFT JOIN hits b ON a.doc_id = b.doc_id AND a.license = b.license AND a.g = b.g AND b.k = a.k - a.c),
runs AS (SELECT a.doc_id, a.license, a.size, a.pos AS first, b.pos AS last,
    sum((b.back < a.pos)::INT) OVER (PARTITION BY a.doc_id, a.license, a.pos ORDER BY b.pos) AS n
  FROM backed a JOIN backed b ON a.doc_id = b.doc_id AND a.license = b.license AND b.pos >= a.pos AND b.pos - a.pos < a.size * {2 - threshold} / {threshold}),
met AS (SELECT *, 2.0 * n / (last - first + 1 + size) AS dice FROM runs WHERE 2.0 * n / (last - first + 1 + size) >= {threshold}),
own AS (SELECT doc_id, license, first, max(dice) AS dice, arg_min(last, (-dice, last)) AS last FROM met GROUP BY doc_id, license, first),
ended AS (SELECT *, max(last) OVER (PARTITION BY doc_id, license ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM own)
SELECT doc_id, license, round(max(dice)::DOUBLE, 9) AS dice, arg_min(first, (-dice, first))::BIGINT AS start_word,
  arg_min(last - first + 2, (-dice, first))::BIGINT AS n_words, count(*) FILTER (WHERE before IS NULL OR first > before)::BIGINT AS n_regions
FROM ended GROUP BY doc_id, license"""
