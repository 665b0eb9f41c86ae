"""Licence texts in documents: Dice coefficient of word pairs, candidates by size.

Texts are normalised alike: lower case, and anything but letters and digits is a word
boundary. Lines, blocks of lines without a blank line between them, and whole texts are
compared with the templates by their pairs of neighbouring words, counted as often as
they occur. Of a and b pairs, two passages have a Dice coefficient of at most 2 min(a, b) / (a + b); so a passage is
compared only with templates whose size allows the coefficient asked for, which are
found by an equality join on the number of pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Least Dice coefficient, in hundredths.
LEAST_DICE = 80

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this
software and associated documentation files (the "Software"), to deal in the Software without
restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions: The above copyright notice
and this permission notice shall be included in all copies or substantial portions of the
Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE
AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM,
DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except
in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
specific language governing permissions and limitations under the License."""

GPL_2_HEADER = """This program is free software; you can redistribute it and/or modify it under the terms of the
GNU General Public License as published by the Free Software Foundation; either version 2 of the
License, or (at your option) any later version. This program is distributed in the hope that it
will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY
or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You
should have received a copy of the GNU General Public License along with this program; if not,
write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA
02110-1301 USA."""

GPL_3_HEADER = """This program is free software: you can redistribute it and/or modify it under the terms of the
GNU General Public License as published by the Free Software Foundation, either version 3 of the
License, or (at your option) any later version. This program is distributed in the hope that it
will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY
or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You
should have received a copy of the GNU General Public License along with this program. If not,
see <https://www.gnu.org/licenses/>."""

AGPL_3_HEADER = """This program is free software: you can redistribute it and/or modify it under the terms of the
GNU Affero General Public License as published by the Free Software Foundation, either version 3
of the License, or (at your option) any later version. This program is distributed in the hope
that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License
for more details. You should have received a copy of the GNU Affero General Public License along
with this program. If not, see <https://www.gnu.org/licenses/>."""

LGPL_2_HEADER = """This library is free software; you can redistribute it and/or modify it under the terms of the
GNU Lesser General Public License as published by the Free Software Foundation; either version
2.1 of the License, or (at your option) any later version. This library is distributed in the
hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License
for more details. You should have received a copy of the GNU Lesser General Public License along
with this library; if not, write to the Free Software Foundation, Inc., 51 Franklin Street,
Fifth Floor, Boston, MA 02110-1301 USA"""

LGPL_3_HEADER = """This library is free software; you can redistribute it and/or modify it under the terms of the
GNU Lesser General Public License as published by the Free Software Foundation; either version 3
of the License, or (at your option) any later version. This library is distributed in the hope
that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License
for more details. You should have received a copy of the GNU Lesser General Public License along
with this library; if not, write to the Free Software Foundation, Inc., 51 Franklin Street,
Fifth Floor, Boston, MA 02110-1301 USA"""

MPL_HEADER = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy
of the MPL was not distributed with this file, You can obtain one at
http://mozilla.org/MPL/2.0/."""

BSD_3 = """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met: 1. Redistributions of source code must retain
the above copyright notice, this list of conditions and the following disclaimer. 2.
Redistributions in binary form must reproduce the above copyright notice, this list of
conditions and the following disclaimer in the documentation and/or other materials provided
with the distribution. 3. Neither the name of the copyright holder nor the names of its
contributors may be used to endorse or promote products derived from this software without
specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND
CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO
EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF
SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF
THE POSSIBILITY OF SUCH DAMAGE."""

BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met: 1. Redistributions of source code must retain
the above copyright notice, this list of conditions and the following disclaimer. 2.
Redistributions in binary form must reproduce the above copyright notice, this list of
conditions and the following disclaimer in the documentation and/or other materials provided
with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS
IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES
OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND
ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE
OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE."""

ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without
fee is hereby granted, provided that the above copyright notice and this permission notice
appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN
NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES
OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""

#: The notices, file headers and short full texts by which these licences are
#: commonly given. The licences behind the headers are long; their own texts are not compared.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", MIT),
    ("Apache-2.0", APACHE_HEADER),
    ("GPL-2.0-or-later", GPL_2_HEADER),
    ("GPL-3.0-or-later", GPL_3_HEADER),
    ("AGPL-3.0-or-later", AGPL_3_HEADER),
    ("LGPL-2.1-or-later", LGPL_2_HEADER),
    ("LGPL-3.0-or-later", LGPL_3_HEADER),
    ("MPL-2.0", MPL_HEADER),
    ("BSD-3-Clause", BSD_3),
    ("BSD-2-Clause", BSD_2),
    ("ISC", ISC),
)

NOT_WORD = r"[^\\p{L}\\p{N}]+"


def words_of(text: str) -> str:
    """SQL for the normalised words of a text."""
    return f"array_remove(split(lower({text}), '{NOT_WORD}'), '')"


def pairs_of(words: str) -> str:
    """SQL for the pairs of neighbouring words, in order; a lone word is a pair by itself."""
    return (
        f"if(size({words}) < 2, {words}, zip_with(slice({words}, 1, size({words}) - 1),"
        f" slice({words}, 2, size({words})), (a, b) -> concat(a, ' ', b)))"
    )


def size_bounds(n: str, least_dice: int) -> str:
    """SQL for the sizes of sets that may reach the coefficient with a set of ``n``."""
    low = f"cast(ceil({n} * {least_dice} / ({200 - least_dice}.0)) as int)"
    high = f"cast(floor({n} * {200 - least_dice} / ({least_dice}.0)) as int)"
    return f"sequence({low}, {high})"


def template_sizes(spark: SparkSession, templates, least_dice: int) -> DataFrame:
    """A row for each template and each size it may be compared with; as many as the list gives."""
    listed = spark.createDataFrame(
        [(i, name, text) for i, (name, text) in enumerate(templates)],
        "template int, license string, template_text string",
    )
    worded = listed.withColumn("template_words", F.expr(words_of("template_text")))
    paired = worded.withColumn("template_pairs", F.expr(pairs_of("template_words")))
    return paired.select(
        "template", "license", "template_pairs",
        F.explode(F.expr(size_bounds("size(template_pairs)", least_dice))).alias("n"),
    )


def passages(docs: DataFrame) -> DataFrame:
    """doc_id, kind, words and number of pairs of the lines, blocks and whole texts of ``docs``."""
    # one class of characters, which takes no stack however many blank lines there are
    blank = "\\\\n[ \\\\t\\\\r\\\\f\\\\x0B\\\\n]*\\\\n"
    lined = docs.where("text <> ''").withColumn(
        "lines", F.expr(f"transform(split(text, '\\n'), l -> {words_of('l')})")
    )
    kinds = (
        "concat(transform(lines, w -> named_struct('kind', 'line', 'words', w)),"
        " if(size(lines) > 1, array(named_struct('kind', 'text', 'words', flatten(lines))), array()),"
        f" if(text rlike '{blank}', transform(split(text, '{blank}'),"
        f" b -> named_struct('kind', 'block', 'words', {words_of('b')})), array()))"
    )
    # the outer form: the plain one would compute the array once more, to filter by its size
    cut = lined.select("doc_id", F.explode_outer(F.expr(kinds)).alias("p"))
    return cut.select(
        "doc_id", "p.kind", "p.words", F.expr("greatest(size(p.words) - 1, 1)").alias("n")
    ).where("size(words) > 0")


def license_matches(
    docs: DataFrame, templates=TEMPLATES, least_dice: int = LEAST_DICE
) -> DataFrame:
    """doc_id, license, dice and number of passages for every licence that a document holds.

    ``dice`` is the highest coefficient, in millionths rounded down. A null or empty
    text, and passages without words, hold none. Rows that repeat an id are one
    document. A row without an id is reported with the id null. Other columns are not
    read.
    """
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sizes = template_sizes(docs.sparkSession, templates, least_dice)
    # the broadcast side has as many rows as the templates allow sizes
    compared = passages(chosen).join(F.broadcast(sizes), "n").select(
        "doc_id", "license", "n", "template_pairs", F.expr(pairs_of("words")).alias("pairs"),
        F.expr("n + size(template_pairs)").alias("total"),
    )
    # pairs that repeat in the template may be shared more than once
    hopeful = compared.where(
        "(size(array_intersect(pairs, template_pairs)) + size(template_pairs)"
        f" - size(array_distinct(template_pairs))) * 200 >= total * {least_dice}"
    )
    both = (
        "aggregate(transform(array_distinct(template_pairs), p -> least("
        "size(filter(pairs, q -> q = p)), size(filter(template_pairs, q -> q = p)))),"
        " 0, (sum, x) -> sum + x)"
    )
    return (
        hopeful.withColumn("both", F.expr(both))
        .where(f"both * 200 >= total * {least_dice}")
        .groupBy("doc_id", "license")
        .agg(
            F.max(F.expr("both * 2000000L div total")).alias("dice"),
            F.count("*").alias("passages"),
        )
    )
