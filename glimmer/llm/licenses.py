"""Operator 8, license scans: a positional index of licence words, probed with the rarest ones.

One pass over the texts keeps, of every word, only those of the licence vocabulary with their places. From
these the corpus's document frequencies follow, and with them the probes: of each template (short notices, whole
ones, SPDX lines) the words of the highest IDF, as many as no accepted notice can do without. Only files that hold a
probe are looked into: their words meet the templates' postings, vote for (template, relative position), and a position
counts if a probe stands there, at least half of the template's IDF does, and its mandatory key phrase, word for word. Plain phrases of the base list are found
wherever their words stand consecutively.

Words are the maximal runs of characters other than ASCII non-alphanumerics, A-Z lower-cased; all other
letters stay as they are. Defined results: a null or empty text has no words, no places, score 0 and empty
labels; repeated rows are scanned each on their own; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glimmer.llm.shared import settled

#: Phrases that count wherever they stand, with their labels.
BASE_PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    key: str  #: must stand in the template; mandatory in a file


#: Whole notices as published, lower case, words only, by label.
MIT = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
ISC = "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"
BSD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
BSD_DISCLAIMER = "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
APACHE = "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"
GPL = "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program if not see https www gnu org licenses"
MPL = "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"
ZLIB = "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"
UNLICENSE = "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"

#: Identifiers of a SPDX line, lower case, words only, by label.
SPDX = (("apache-2.0", "apache 2 0"), ("bsd", "bsd 2 clause"), ("bsd", "bsd 3 clause"), ("cc-by", "cc by 4 0"), ("cc-by-nc", "cc by nc 4 0"), ("cc-by-nd", "cc by nd 4 0"), ("cc-by-sa", "cc by sa 4 0"), ("cc0", "cc0 1 0"), ("gpl", "gpl 2 0"), ("gpl", "gpl 3 0"), ("lgpl", "lgpl 2 1"), ("lgpl", "lgpl 3 0"), ("agpl", "agpl 3 0"), ("isc", "isc"), ("mit", "mit"), ("mpl-2.0", "mpl 2 0"), ("unlicense", "unlicense"), ("zlib", "zlib"))

#: Short notices, whole ones and SPDX lines, each with the phrase without which it isn't meant.
TEMPLATES = (
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "apache org licenses license 2 0"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "binary forms"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    Template("cc0", "creative commons zero public domain dedication", "public domain dedication"),
    Template("gpl", "licensed under the gnu general public license version 3", "gnu general public license"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "general public license"),
    Template("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    Template("agpl", "licensed under the gnu affero general public license", "affero general public license"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "hereby granted"),
    Template("mit", "released under the mit license", "mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "person obtaining"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software"),
    Template("zlib", "alter it and redistribute it freely subject to the following restrictions", "redistribute it freely"),
    Template("apache-2.0", APACHE, "apache license version 2 0"),
    Template("bsd", BSD, "binary forms"),
    Template("bsd", BSD_DISCLAIMER, "copyright holders and contributors"),
    Template("gpl", GPL, "gnu general public license"),
    Template("lgpl", GPL.replace("general public license", "lesser general public license"), "gnu lesser general public license"),
    Template("agpl", GPL.replace("general public license", "affero general public license"), "gnu affero general public license"),
    Template("isc", ISC, "with or without fee"),
    Template("mit", MIT, "person obtaining"),
    Template("mpl-2.0", MPL, "mozilla public license"),
    Template("unlicense", UNLICENSE, "unencumbered software"),
    Template("zlib", ZLIB, "redistribute it freely"),
    *[Template(label, f"spdx license identifier {x}", f"spdx license identifier {x}") for label, x in SPDX],
)

#: Words too plain to be looked up; they still count where a key phrase holds them.
PLAIN = frozenset(
    "a above all along an and any anyone appear are arising as at be but by can caused copies copy data details direct do either event even file files for form free from hands have hope however if in including into is it kind later law list "
    "may means met more must name neither no not of on one or order other otherwise out over part person persons provided public purpose received required resulting see sell shall should so source subject substantial such terms than that the these "
    "this to under use useful v version was way whether which who whom will with without written you your 0 1 2 3 4".split()
)

BREAK = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def _vocabulary(templates: tuple[Template, ...]) -> tuple[list[str], list[str]]:
    """Words that are looked up, and all words whose places are kept."""
    rare = {w for t in templates for w in t.text.split()} - PLAIN
    keys = {w for t in templates for w in t.key.split()} | {w for p, _ in BASE_PHRASES for w in p.split()}
    return sorted(rare), sorted(rare | keys)


def licence_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """id, n_words and hits, array<struct<w, p>>: the licence vocabulary's words with their places.

    Plain words are kept only next to another licence word, where they can belong to a phrase.
    """
    rare, kept = _vocabulary(templates)
    rows = docs.select(F.col(id_col), F.array_remove(F.split(F.coalesce(F.col(text_col), F.lit("")), BREAK), "").alias("__w"))
    known = lambda w, of: F.lower(w).isin(*of) & (F.length(w) == F.octet_length(w))
    plain = sorted(set(kept) - set(rare))
    # A plain word needs a neighbour from the vocabulary.
    near = lambda i: known(F.get("__w", i - 1), kept) | known(F.get("__w", i + 1), kept)
    hit = lambda w, i: F.coalesce(known(w, rare) | (known(w, plain) & F.coalesce(near(i), F.lit(False))), F.lit(False))
    places = F.filter(F.transform("__w", lambda w, i: F.when(hit(w, i), F.struct(F.lower(w).alias("w"), i.alias("p")))), lambda x: x.isNotNull())
    return rows.select(F.col(id_col), F.size("__w").cast("long").alias("n_words"), places.alias("hits"))


def _base(hits: Column) -> Column:
    """array<struct<p, label>>: places where a base phrase's words stand consecutively."""

    def at(x: Column, k: Column) -> Column:
        found = F.lit(None).cast("string")
        for phrase, label in BASE_PHRASES:
            fits = F.lit(True)
            for j, w in enumerate(phrase.split()):
                other = x if not j else F.get("hits", k + j)
                fits = fits & (other["w"] == w) & (other["p"] == x["p"] + j)
            found = F.when(F.coalesce(fits, F.lit(False)), F.lit(label)).otherwise(found)
        return F.struct(x["p"].alias("p"), found.alias("label"))

    return F.filter(F.transform(hits, at), lambda x: x["label"].isNotNull())


@dataclass(frozen=True)
class Posting:
    """Where a word stands in a template: weight is its IDF, key marks the key phrase, probe what is looked up first."""

    w: str
    t: int
    i: int
    weight: float
    key: bool
    probe: bool


def postings(templates: tuple[Template, ...], idf: dict[str, float], coverage: float) -> tuple[list[Posting], list[float]]:
    """The positional index, and the whole weight of each template.

    Of each template the words of the highest IDF are probes, as many as it takes until the rest weighs less than
    coverage: a notice that has so much of the template in place has a probe in place.
    """
    out, totals = [], []
    for t, template in enumerate(templates):
        words, key = template.text.split(), template.key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
        weight = {w: idf[w] * words.count(w) for w in words if w not in PLAIN}
        total = sum(weight.values())
        rest, probes = total, set()
        for w in sorted(weight, key=lambda w: (-idf[w], w)):
            if rest < coverage * total - 1e-6:
                break
            probes.add(w)
            rest -= weight[w]
        totals.append(total)
        out += [Posting(w, t, i, idf[w] if w not in PLAIN else 0.0, at <= i < at + len(key), w in probes) for i, w in enumerate(words) if w not in PLAIN or at <= i < at + len(key)]
    return out, totals


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES, coverage: float = 0.5) -> DataFrame:
    """id, n_words, places (array<struct<p, label>> of base phrases), found (array<struct<label, start, score>>
    of templates) and score: the largest coverage of an accepted template, 1 where a base phrase stands, else 0.

    coverage: the least share of a template's IDF (plain words have none) that must stand in place.
    """
    kept = _vocabulary(templates)[1]
    rows = settled(licence_words(docs, id_col, text_col, templates).withColumn("row", F.monotonically_increasing_id()))
    n = rows.count()
    # At most one row for each word of the vocabulary, a constant of the templates.
    counted = rows.select(F.explode(F.array_distinct(F.col("hits.w"))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    df = dict(counted.collect())
    idf = {w: round(math.log((n + 1) / (df.get(w, 0) + 1)) + 1, 6) for w in kept}
    index, totals = postings(templates, idf, coverage)
    probes = sorted({x.w for x in index if x.probe})
    table = docs.sparkSession.createDataFrame([(x.w, x.t, x.i, x.weight, x.key, x.probe) for x in index], "w string, t int, i int, weight double, key boolean, probe boolean")
    # Only files with a probe are looked into; each of their places meets the few postings of its word.
    looked = rows.where(F.exists("hits", lambda h: h["w"].isin(*probes))).select("row", F.explode("hits").alias("h")).select("row", "h.w", "h.p")
    votes = looked.join(F.broadcast(table), "w").select("row", "t", (F.col("p") - F.col("i")).alias("start"), F.col("key").cast("int").alias("key"), "weight", F.col("probe"))
    keys = [len(t.key.split()) for t in templates]
    labels = [t.label for t in templates]
    by = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("t") + 1)
    # A template has few words, so this group never has more rows than it.
    met = votes.groupBy("row", "t", "start").agg(F.sum("key").alias("keys"), F.sum("weight").alias("weight"), F.max("probe").alias("probe")).where(F.col("probe") & (F.col("keys") == by(keys)) & (F.col("weight") >= coverage * by(totals) - 1e-9))
    best = met.groupBy("row", by(labels).alias("label"), F.greatest(F.col("start"), F.lit(0)).cast("long").alias("start")).agg(F.max(F.least(F.lit(1.0), F.col("weight") / by(totals))).alias("score"))
    found = best.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("label", "start", "score"))).alias("found"))
    empty = F.expr("cast(array() as array<struct<label: string, start: bigint, score: double>>)")
    out = rows.withColumn("places", _base(F.col("hits"))).join(found, "row", "left").withColumn("found", F.coalesce("found", empty))
    score = F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.col("found.score")), F.lit(0.0)))
    return out.select(F.col(id_col), "n_words", "places", "found", F.round(score, 6).alias("score"))
