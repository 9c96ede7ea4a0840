"""Licence scans by sentences: known sentences become identifiers, and ordered rules name the licence."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gravitas.llm.text import unique_documents

#: Known sentences and rules up to this size are sent to every task; beyond it both sides are shuffled.
BROADCAST_BYTES = 16 << 20

#: Patterns begin at an end mark or a line break, so that long runs of blanks or marks are passed over once; blanks and
#: marks that stay with a sentence vanish when it is normalised.
SENTENCE_END = r"[.!?;:]\s+|\n\s*"
#: What also ends a sentence wrapped over several lines: an end mark, an empty line or the mark of a list item.
WRAPPED_END = r"[.!?;:]\s+|\n[^\S\n]*\n\s*|\n[^\S\n]*(?=[-\u2022]\s|\(?[0-9]{1,2}[.)]\s)"

#: Rules: a name, the licence, and its sentences in order. The wording is that of the public licence notices.
RULES: dict[str, tuple[str, list[str]]] = {
    "mit-notice": ("MIT", ["Released under the MIT License"]),
    "mit-notice-licensed": ("MIT", ["Licensed under the MIT License"]),
    "mit-spdx": ("MIT", ["SPDX-License-Identifier: MIT"]),
    "mit-text": (
        "MIT",
        [
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
        ],
    ),
    "apache-2-notice": ("Apache-2.0", ["Licensed under the Apache License, Version 2.0"]),
    "apache-2-spdx": ("Apache-2.0", ["SPDX-License-Identifier: Apache-2.0"]),
    "apache-2-header": (
        "Apache-2.0",
        [
            "Licensed under the Apache License, Version 2.0 (the \"License\")",
            "you may not use this file except in compliance with the License",
            "You may obtain a copy of the License at",
        ],
    ),
    "gpl-3-notice": ("GPL-3.0", ["This work is licensed under the GNU General Public License, version 3"]),
    "gpl-3-header": (
        "GPL-3.0-or-later",
        [
            "This program is free software",
            "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
            "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
        ],
    ),
    "gpl-2-header": (
        "GPL-2.0-or-later",
        [
            "This program is free software",
            "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
            "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
        ],
    ),
    "gpl-2-notice": ("GPL-2.0", ["This work is licensed under the GNU General Public License, version 2"]),
    "gpl-2-spdx": ("GPL-2.0-only", ["SPDX-License-Identifier: GPL-2.0-only"]),
    "gpl-3-spdx": ("GPL-3.0-only", ["SPDX-License-Identifier: GPL-3.0-only"]),
    "lgpl-2-1-header": (
        "LGPL-2.1-or-later",
        [
            "This library is free software",
            "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
            "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
        ],
    ),
    "lgpl-3-header": (
        "LGPL-3.0-or-later",
        [
            "This program is free software",
            "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
            "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
        ],
    ),
    "agpl-3-header": (
        "AGPL-3.0-or-later",
        [
            "This program is free software",
            "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
            "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
        ],
    ),
    "mpl-2-header": ("MPL-2.0", ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"]),
    "mpl-2-spdx": ("MPL-2.0", ["SPDX-License-Identifier: MPL-2.0"]),
    "isc-text": (
        "ISC",
        [
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
        ],
    ),
    "isc-text-and": (
        "ISC",
        [
            "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
        ],
    ),
    "isc-spdx": ("ISC", ["SPDX-License-Identifier: ISC"]),
    "cc0-1-notice": (
        "CC0-1.0",
        [
            "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
        ],
    ),
    "cc0-1-spdx": ("CC0-1.0", ["SPDX-License-Identifier: CC0-1.0"]),
    "all-rights-reserved": ("LicenseRef-All-Rights-Reserved", ["All rights reserved"]),
    "bsd-2-spdx": ("BSD-2-Clause", ["SPDX-License-Identifier: BSD-2-Clause"]),
    "bsd-3-spdx": ("BSD-3-Clause", ["SPDX-License-Identifier: BSD-3-Clause"]),
    "bsd-2-text": (
        "BSD-2-Clause",
        [
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
            "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
            "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
        ],
    ),
    "bsd-3-text": (
        "BSD-3-Clause",
        [
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
            "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
            "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
            "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        ],
    ),
    "bsd-3-text-university": (
        "BSD-3-Clause",
        [
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
            "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
            "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
            "Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        ],
    ),
    "bsd-3-text-organization": (
        "BSD-3-Clause",
        [
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
            "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
            "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
            "Neither the name of the <organization> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        ],
    ),
    "cc-by-notice": ("CC-BY-4.0", ["Licensed under CC BY 4.0"]),
    "cc-by-sa-notice": ("CC-BY-SA-4.0", ["Licensed under CC BY-SA 4.0"]),
    "cc-by-nc-notice": ("CC-BY-NC-4.0", ["Licensed under CC BY-NC 4.0"]),
}


def normal(sentence: Column) -> Column:
    """A-Z in lower case, runs of anything but letters and digits of ASCII as one space."""
    lower = F.translate(sentence, string.ascii_uppercase, string.ascii_lowercase)
    return F.trim(F.regexp_replace(lower, "[^a-z0-9]+", " "))


def sentences_of(text: str | Column) -> Column:
    return F.split(text, SENTENCE_END)


def all_sentences(text: Column) -> Column:
    """Sentences that are not empty, each as ``sentence`` and, for the first of ``n`` lines that go on without an end,
    all these lines as ``wrapped`` (else empty, and ``n`` is 1)."""

    def lines(part: Column) -> Column:
        return F.filter(F.transform(sentences_of(part), normal), lambda s: s != "")

    def entries(group: Column) -> Column:
        def entry(s: Column, i: Column) -> Column:
            first = (i == 0) & (F.size(group) > 1)
            joined = F.when(first, F.array_join(group, " ")).otherwise("")
            return F.struct(s.alias("sentence"), joined.alias("wrapped"), F.when(first, F.size(group)).otherwise(1).alias("n"))

        return F.transform(group, entry)

    return F.flatten(F.transform(F.transform(F.split(text, WRAPPED_END), lines), entries))


def default_rules(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Known sentences ``(sid, sentence)`` and rules ``(rule, license, sids)``.

    A rule's text is cut and numbered like a document, so a colon inside it makes two sentences there as well.
    """
    rows = [(name, license, "\n".join(sentences)) for name, (license, sentences) in RULES.items()]
    cut = spark.createDataFrame(rows, "rule string, license string, text string")
    parts = cut.select("rule", "license", F.posexplode(sentences_of("text")).alias("no", "raw")).withColumn("sentence", normal(F.col("raw")))
    numbered = parts.select("sentence").distinct().withColumn("sid", F.xxhash64("sentence"))
    rules = parts.withColumn("sid", F.xxhash64("sentence")).groupBy("rule", "license").agg(F.transform(F.array_sort(F.collect_list(F.struct("no", "sid"))), lambda x: x["sid"]).alias("sids"))
    return numbered.select("sid", "sentence"), rules


def sent_if_small(df: DataFrame, size: Column) -> DataFrame:
    """Marked for broadcast if the measured bytes of its rows stay below ``BROADCAST_BYTES``."""
    taken = df.agg(F.coalesce(F.sum(size + 40), F.lit(0))).first()[0]
    return F.broadcast(df) if taken <= BROADCAST_BYTES else df


def scan_licenses(docs: DataFrame, known: DataFrame | None = None, rules: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_sentences, n_known, matches``: matches as sorted array of (license, rule, sentence number).

    The known sentences of a document, in order, are its identifiers; sentences not known are passed over. A line break
    ends a sentence, but where the lines up to the next end mark, empty line or list item make one known sentence, that
    one stands in place of its lines under the number of the first. A rule matches where its identifiers stand one after
    the other; of rules that begin alike at one place only the longest counts. Rules and sentences default to ``RULES``;
    their measured size decides whether they are sent to all tasks. Null and empty texts have no sentences. Rows that
    share an id are one document, see ``unique_documents``; repeated sentences match as often as they stand there. An
    empty table gives an empty result. Only the two named columns are read.
    """
    if known is None or rules is None:
        known, rules = default_rules(docs.sparkSession)
    plain = unique_documents(docs, id_col, text_col)
    # A document's first row stands for the document itself and also carries its number of sentences.
    cut = plain.select("doc_id", all_sentences(F.coalesce("text", F.lit(""))).alias("all"))
    head = F.array(F.struct(F.lit("").alias("sentence"), F.lit("").alias("wrapped"), F.lit(1).alias("n")))
    numbered = cut.select("doc_id", F.size("all").alias("n_sentences"), F.posexplode(F.concat(head, "all")).alias("no", "s"))
    line = F.struct(F.col("s.sentence").alias("sentence"), F.lit(1).alias("n"))
    lines = F.struct(F.col("s.wrapped").alias("sentence"), F.col("s.n").alias("n"))
    each = numbered.select("doc_id", "n_sentences", "no", F.inline(F.when(F.col("s.n") > 1, F.array(line, lines)).otherwise(F.array(line))))
    known_or_head = each.join(sent_if_small(known, F.octet_length("sentence")), "sentence", "left").where("no = 0 or sid is not null").drop("sentence")
    # Lines of a known wrapped sentence are not sentences of their own.
    earlier = W.partitionBy("doc_id").orderBy("no", F.desc("n")).rowsBetween(W.unboundedPreceding, -1)
    reach = F.max(F.col("no") + F.col("n") - 1).over(earlier)
    found = known_or_head.withColumn("reach", reach).where("reach is null or reach < no").drop("reach", "n")
    longest = rules.agg(F.coalesce(F.max(F.size("sids")), F.lit(1))).first()[0]
    order = W.partitionBy("doc_id").orderBy("no")
    ahead = found.withColumn("next", F.collect_list("sid").over(order.rowsBetween(0, longest - 1)))
    headed = sent_if_small(rules.withColumn("head", F.get("sids", F.lit(0))), 8 * F.size("sids"))
    tried = ahead.join(headed, (F.col("sid") == F.col("head")) & (F.col("no") > 0), "left")
    size = F.when(F.slice("next", 1, F.size("sids")) == F.col("sids"), F.size("sids"))
    best = tried.withColumn("size", size).withColumn("best", F.max("size").over(W.partitionBy("doc_id", "no")))
    hit = F.when(F.col("size") == F.col("best"), F.struct("license", "rule", "no"))
    return best.groupBy("doc_id").agg(
        F.max("n_sentences").cast("long").alias("n_sentences"), F.countDistinct(F.when(F.col("no") > 0, F.col("no"))).alias("n_known"), F.array_sort(F.collect_set(hit)).alias("matches")
    )
