"""License scans by diagonal voting, with DataFrame operations only.

All rolling hashes of ``k`` words of the documents are joined with the places where they stand in license templates; a
match counts if the words are the same. Each match votes for the diagonal ``place in text - place in template``. An
undisturbed copy of a template puts all its votes on one diagonal; words that were put in or left out move the rest to a
neighbouring one, so diagonals at most ``gap`` apart are merged. A merged span is verified: its matches are at least
``coverage`` of the template's k-grams, each counted once; its length is near the template's; it has the same words of
:data:`MARKS` as the template, which tell licenses of one family apart; and it is aligned with the template along its
matches: where a telling word (see :func:`telling`) is missing, no word may stand that is in no template, unless it is the
same word misspelt. So a notice with another license's name, or with "denied" for "granted", is none. Where spans of different labels overlap, the best
covered one stays. The templates are a fixed list, so they are the broadcast side.

Documents without any of :func:`anchors`' words can't reach the coverage, so their words are not taken apart.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words before lower-casing.
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: A text without a match here has no base phrase.
MAYBE = r"(?i)license|cc[\x00-\x2F\x3A-\x60\x7B-\x7F]+by"
#: Notices by which works commonly name their license.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("gpl", "licensed under the gnu general public license version 3"),
    ("gpl", "free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("lgpl", "licensed under the gnu lesser general public license version 3"),
    ("agpl", "licensed under the gnu affero general public license version 3"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required altered source versions must be plainly marked as such and must not be misrepresented as being the original software this notice may not be removed or altered from any source distribution"),
]
#: Words by which a license differs from others of its family.
MARKS = "lesser library affero nc noncommercial commercial sa sharealike alike nd noderivatives noderivs derivatives".split()


LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class LicenseScan:
    k: int = 3
    gap: int = 3
    coverage: float = 0.75
    stretch: float = 1.5
    context: int = 8


def telling() -> list[str]:
    """Words that tell templates apart: those that stand in templates of at most a quarter of the labels."""
    labels = {label for label, _ in TEMPLATES}
    of: dict[str, set[str]] = {}
    for label, text in TEMPLATES:
        for word in text.split():
            of.setdefault(word, set()).add(label)
    return sorted(w for w, own in of.items() if 4 * len(own) <= len(labels))


def foreign(said: Column, missing: Column) -> Column:
    """Whether words of a text stand in place of the ``missing`` ones of a template that change what it says: a telling word is
    missing, and a word is there that is in no template and is none of the missing ones misspelt. :data:`MARKS` have a rule of their own."""
    known = sorted({w for _, text in TEMPLATES for w in text.split()} | set(MARKS))
    near = lambda s: F.exists(missing, lambda t: F.levenshtein(s, t) * 4 <= F.length(t))
    return F.exists(missing, lambda t: t.isin(telling())) & F.exists(said, lambda s: ~s.isin(known) & ~near(s))


def altered(pairs: Column, template: Column, conf: LicenseScan) -> Column:
    """Whether a span says something else than its template: :func:`foreign` words before, between or behind its matches.

    ``pairs``: the matches in order, with place, at, and the ``context`` words before (``behind``) and after (``ahead``) them."""
    k = conf.k
    part = lambda w, first, n: F.slice(w, F.greatest(first, F.lit(1)), F.greatest(n, F.lit(0)))
    first, last = F.get(pairs, F.lit(0)), F.get(pairs, F.size(pairs) - 1)
    ahead = F.least(first["at"], F.size(first["behind"]))
    before = foreign(part(first["behind"], F.size(first["behind"]) - ahead + 1, ahead), part(template, F.lit(1), first["at"]))
    left = F.size(template) - last["at"] - k
    after = foreign(part(last["ahead"], F.lit(1), left), part(template, last["at"] + k + 1, left))
    steps = F.zip_with(F.slice(pairs, F.lit(1), F.size(pairs) - 1), F.slice(pairs, F.lit(2), F.size(pairs)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    gap = lambda x: foreign(part(x["a"]["ahead"], F.lit(1), x["b"]["place"] - x["a"]["place"] - k), part(template, x["a"]["at"] + k + 1, x["b"]["at"] - x["a"]["at"] - k))
    broken = lambda x: (x["b"]["place"] - x["a"]["place"] > k) & (x["b"]["at"] - x["a"]["at"] > k)
    return before | after | F.exists(F.filter(steps, broken), gap)


def words(text: Column) -> Column:
    """Words with A-Z lower-cased and no other letter changed."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), LETTERS, LETTERS.lower()), F.lit(WORD), F.lit(0))


def rolling(words: Column, k: int) -> Column:
    """A hash of each ``k`` consecutive words, at the place of the first; beyond the last whole one, hashes of fewer words."""
    return F.transform(words, lambda w, i: F.xxhash64(w, *[F.get(words, i + F.lit(j)) for j in range(1, k)]))


def anchors(conf: LicenseScan) -> list[str]:
    """Words of which a text with a template's span has at least one: for each template, so many that a text without all of
    them lacks more k-grams than ``coverage`` allows. Words rare in English go first, judged by their length."""
    out: set[str] = set()
    for _, text in TEMPLATES:
        listed = text.split()
        grams = [set(listed[i : i + conf.k]) for i in range(len(listed) - conf.k + 1)]
        mine: set[str] = set()
        for word in sorted(set(listed), key=lambda w: (w not in out, -len(w), w)):
            if sum(not mine & g for g in grams) < conf.coverage * len(grams):
                break
            mine.add(word)
        out |= mine
    return sorted(out)


def spans(documents: DataFrame, conf: LicenseScan) -> DataFrame:
    """Verified template spans by distinct (doc_id, text_hash): label, first_word, end_word, coverage, n_template."""
    spark = documents.sparkSession
    listed = spark.createDataFrame([(i, label, text.split(), [w for w in text.split() if w in MARKS]) for i, (label, text) in enumerate(TEMPLATES)], "template int, label string, w array<string>, own array<string>")
    grams = listed.select("template", "label", "own", "w", F.size("w").alias("n_template"), F.posexplode(rolling(F.col("w"), conf.k)).alias("at", "gram")).filter(f"at <= n_template - {conf.k}")
    grams = grams.withColumn("expected", F.slice("w", F.col("at") + 1, conf.k)).drop("w")
    known = [r.gram for r in grams.select("gram").distinct().collect()]  # some hundred numbers, from the fixed list
    texts = documents.filter(F.col("text").rlike("(?i)" + "|".join(anchors(conf))))
    # an explode of one row: the optimizer does not move the taking apart of a text behind it into what is done for each word
    texts = texts.select("doc_id", "text_hash", F.explode(F.array(words(F.col("text")))).alias("w"))
    marks = F.array_compact(F.transform("w", lambda w, i: F.when(w.isin(MARKS), F.struct(w.alias("word"), i.alias("at")))))
    hashed = F.transform(rolling(F.col("w"), conf.k), lambda g, i: F.when(g.isin(known), F.struct(i.alias("place"), g.alias("gram"))))
    # before the words are dealt out as rows: once a text, and only the places of template hashes
    texts = texts.select("doc_id", "text_hash", "w", F.array_compact(hashed).alias("hits")).filter(F.size("hits") > 0).withColumn("marks", marks)
    rolled = texts.select("doc_id", "text_hash", "marks", F.explode(F.transform("hits", lambda h: F.struct(h.place.alias("place"), h.gram.alias("gram"), F.slice("w", h.place + 1, conf.k).alias("said"), F.slice("w", h.place + 1 + conf.k, F.lit(conf.context)).alias("ahead"), F.slice("w", F.greatest(h.place + 1 - conf.context, F.lit(1)), F.least(h.place, F.lit(conf.context))).alias("behind")))).alias("hit")).select("doc_id", "text_hash", "marks", "hit.*")
    votes = rolled.join(F.broadcast(grams), "gram").filter(F.col("said") == F.col("expected")).withColumn("diagonal", F.col("place") - F.col("at"))
    votes = votes.groupBy("doc_id", "text_hash", "template", "label", "n_template", "diagonal").agg(F.collect_set("at").alias("ats"), F.collect_set(F.struct("place", "at", "ahead", "behind")).alias("pairs"), F.min("place").alias("first_word"), (F.max("place") + conf.k).alias("end_word"), F.first("marks").alias("marks"), F.first("own").alias("own"))
    along = Window.partitionBy("doc_id", "text_hash", "template").orderBy("diagonal")
    step = F.col("diagonal") - F.lag("diagonal").over(along)
    merged = votes.withColumn("new", F.coalesce((step > conf.gap).cast("int"), F.lit(1))).withColumn("island", F.sum("new").over(along))
    merged = merged.groupBy("doc_id", "text_hash", "template", "label", "n_template", "island").agg(F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("votes"), F.array_sort(F.flatten(F.collect_list("pairs"))).alias("pairs"), F.min("first_word").alias("first_word"), F.max("end_word").alias("end_word"), F.first("marks").alias("marks"), F.first("own").alias("own"))
    share = F.col("votes") / (F.col("n_template") - (conf.k - 1))
    near = (F.col("end_word") - F.col("first_word")) <= F.col("n_template") * conf.stretch
    inside = F.transform(F.filter("marks", lambda m: (m.at >= F.col("first_word")) & (m.at < F.col("end_word"))), lambda m: m.word)
    same = (F.size(F.array_except(inside, "own")) == 0) & (F.size(F.array_except("own", inside)) == 0)
    found = merged.withColumn("coverage", share).filter((F.col("coverage") >= conf.coverage) & near & same)
    found = found.join(F.broadcast(listed.select("template", F.col("w").alias("words"))), "template").filter(~altered(F.col("pairs"), F.col("words"), conf))
    return found.select("doc_id", "text_hash", "label", "first_word", "end_word", "coverage", "n_template")


def best_spans(spans: Column) -> Column:
    """``spans`` without those that overlap a better covered one, or else one of a longer template, of another label."""
    ranked = F.array_sort(F.transform(spans, lambda s: F.struct((-s.coverage).alias("c"), (-s.n_template).alias("n"), s.label.alias("label"), s.first_word.alias("first_word"), s.end_word.alias("end_word"), s.coverage.alias("coverage"))))
    plain = F.transform(ranked, lambda s: F.struct(s.label.alias("label"), s.first_word.alias("first_word"), s.end_word.alias("end_word"), s.coverage.alias("coverage")))
    clash = lambda a, b: (a.label != b.label) & (a.first_word < b.end_word) & (b.first_word < a.end_word)
    kept = F.aggregate(plain, F.slice(plain, 1, 0), lambda kept, s: F.when(F.exists(kept, lambda t: clash(s, t)), kept).otherwise(F.concat(kept, F.array(s))))
    return F.array_sort(F.array_distinct(kept))


def scan(documents: DataFrame, conf: LicenseScan = LicenseScan()) -> DataFrame:
    """Per row of ``documents`` (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Base phrases are found wherever their words stand consecutively. ``labels`` are those of base phrases and of verified
    template spans, ``spans`` (array of label, first_word, end_word, coverage) the latter. ``score`` is 1 with a base
    phrase, else the best span's coverage, else 0. A null or empty text has no words and no label. Repeated rows each get
    the full result, as do rows without a doc_id.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    found = spans(docs, conf).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("label", "first_word", "end_word", "coverage", "n_template")).alias("spans"))
    found = found.withColumn("spans", best_spans(F.col("spans")))
    base = docs.select("doc_id", "text_hash", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(ANY_CASE_WORD)).cast("long").alias("n_words"), F.when(F.col("text").rlike(MAYBE), words(F.col("text"))).alias("w"))

    def places(phrase: str) -> Column:
        parts = phrase.split()
        rest = lambda i: [F.get("w", i + F.lit(j)).eqNullSafe(F.lit(part)) for j, part in enumerate(parts[1:], 1)]
        here = lambda w, i: F.when(reduce(lambda a, b: a & b, rest(i), w == parts[0]), i)
        return F.array_compact(F.transform("w", here))

    base = base.select("*", *[F.coalesce(places(p), F.array().cast("array<int>")).alias(label) for p, label in PHRASES.items()])
    every = F.concat(*[F.col(f"`{label}`") for label in PHRASES.values()])
    base_labels = F.array_sort(F.array_compact(F.array(*[F.when(F.size(f"`{label}`") > 0, F.lit(label)) for label in PHRASES.values()])))
    base = base.select("doc_id", "text_hash", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"), base_labels.alias("base"))
    found = found.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), "spans")
    out = base.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")), "left")
    labels = F.array_sort(F.array_distinct(F.concat("base", F.coalesce(F.transform("spans", lambda s: s.label), F.array().cast("array<string>")))))
    score = F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("spans", lambda s: s.coverage)), F.lit(0.0)))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"), "spans")
