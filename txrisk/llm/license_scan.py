"""Licence scan: normalised text against licence templates by the Dice coefficient over word bigrams.

The units of a document are its lines and its whole text. Dice is 2 |A n B| / (|A| + |B|) over distinct bigrams,
so a unit can only reach a threshold t with a template when the sizes satisfy
t / (2 - t) <= |A| / |B| <= (2 - t) / t. A unit meets only the templates that admit its size, by an equality
join on the size; units of other sizes meet none. All of it is column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The notices that the named licences ask for, as (licence id, text).
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]
#: Templates are part of the plan.
MAX_TEMPLATES = 1000


def words(text: Column) -> Column:
    """Words of the normalised text: lower case, everything but letters and digits is a gap.

    A generator: the list becomes a column of its own, which the optimizer can't copy into the lambdas that read it.
    """
    return F.explode(F.array(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")))


def bigrams(w: Column) -> Column:
    """Distinct word bigrams; a single word is its own only bigram."""
    pairs = F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat(F.get(w, i), F.lit(" "), F.get(w, i + 1)))
    return F.when(F.size(w) >= 2, F.array_distinct(pairs)).otherwise(w)


def template_table(spark, templates: list[tuple[str, str]]) -> DataFrame:
    """template, licence, n_template, bigrams; templates without words are left out."""
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"at most {MAX_TEMPLATES} templates")
    rows = [(i, licence, text) for i, (licence, text) in enumerate(templates)]
    table = spark.createDataFrame(rows, "template int, licence string, notice string")
    table = table.select("template", "licence", words(F.col("notice")).alias("w"))
    table = table.select("template", "licence", bigrams(F.col("w")).alias("bigrams"))
    return table.select("template", "licence", F.size("bigrams").alias("n_template"), "bigrams").where("n_template > 0")


def scan_licenses(documents: DataFrame, templates: list[tuple[str, str]] | None = None, percent: int = 80) -> DataFrame:
    """doc_id, licence, dice, n_units for every licence found in ``documents(doc_id, text, ...)``.

    ``dice`` is the best coefficient of the document's units with a template of that licence, ``n_units`` how many
    units reach ``percent``. Documents without a licence (also null, empty and wordless texts) have no row. Ties do
    not matter: only the best value is reported. Rows that repeat a doc_id add up to one document; rows without one
    are scanned as the document null. Other columns are ignored. A unit that repeats in a document counts each time.
    """
    spark = documents.sparkSession
    table = template_table(spark, TEMPLATES if templates is None else templates)
    # Sizes a unit may have for each template: at most a few hundred rows per template.
    low = F.ceil(F.col("n_template") * percent / (200 - percent)).cast("int")
    high = F.floor(F.col("n_template") * (200 - percent) / percent).cast("int")
    candidates = table.withColumn("n_unit", F.explode(F.sequence(F.greatest(low, F.lit(1)), high)))
    text = F.coalesce("text", F.lit(""))
    lines = F.split(text, "\n", -1)
    units = F.when(F.size(lines) > 1, F.concat(F.array(text), lines)).otherwise(lines)
    listed = documents.select("doc_id", F.explode(units).alias("unit")).select("doc_id", words(F.col("unit")).alias("w"))
    sized = listed.select("doc_id", F.explode(F.array(bigrams(F.col("w")))).alias("a")).withColumn("n_unit", F.size("a"))
    shared = F.size(F.array_intersect("a", "bigrams"))
    both = F.col("n_unit") + F.col("n_template")
    return (
        sized.join(F.broadcast(candidates), "n_unit")
        .select("doc_id", "licence", shared.alias("shared"), both.alias("both"))
        .where(F.col("shared") * 200 >= F.col("both") * percent)
        .groupBy("doc_id", "licence")
        .agg(F.max(F.lit(2.0) * F.col("shared") / F.col("both")).alias("dice"), F.count("*").alias("n_units"))
    )
