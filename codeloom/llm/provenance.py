"""Generated, minified, vendored source files and data stored as code.

A random forest over content measures (compression ratio, token entropy, identifier lengths,
comment density and the like) tells files that a machine wrote from hand-written ones. It is
trained on weak labels - header notices of tools, banners of packed scripts, naming
conventions - none of which the measures can see: heading comments are cut off before
measuring, paths are not measured. The forest alone decides on them, labelled or not. Copied
third-party source reads like any hand-written source, so an exact check follows for it: a
notice in the heading comment or a directory that by convention holds other projects.

Defined cases: null content is skipped; empty or blank files are hand-written; a null path
leaves only the content to judge by; repeated file records count once; a table in which no file,
or every file, has a label of machine-made ones cannot teach a forest: the labels decide there.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint, spread
from .syntax import file_paths

#: Most labelled rows of each class the forest is fitted on (a hash-ordered sample); all rows are judged.
MAX_TRAINING_ROWS = 20_000

# Wording of notices, each at the start of a line of the heading comment.
TOOL_NOTICE = re.compile(
    r"(?im)^\W*(?:code generated by\b|@generated\b|<auto-?generated|generated (?:by|from|with|using|automatically)\b"
    r"|auto(?:matically)?[- ]?generated (?:file|code|by|from|on|with)\b|(?:this|the) (?:file|code|class|module|source) (?:was|is|has been)"
    r" (?:auto-?|automatically |machine[- ])?(?:generated|produced|created) (?:by|from|with|on|using)"
    r"|do not (?:edit|modify)\b|dieser? (?:code|datei|quelltext) (?:wurde|ist|wird)\b.*(?:erzeugt|generiert|erstellt)"
    r"|ce (?:fichier|code) (?:a été|est) (?:auto)?.*génér|este (?:archivo|fichero|código) (?:fue|ha sido|es|se)\b.*gener|由.{0,60}生成|本文件由|自动生成)"
)
COPY_NOTICE = re.compile(
    r"(?im)^\W*(?:part of [\w.-]+ v?\d+\.\d|(?:bundled|vendored|verbatim|unmodified|local) copy of [\w.-]+ v?\d|(?:taken|copied|imported|vendored)"
    r" (?:verbatim |unchanged |unmodified )?from [\w.-]+ v?\d|[\w.-]+ v?\d+\.\d[\w.]* - (?:imported|copied|taken|vendored)|vendored from\b|third[- ]party (?:code|source|library)\b)"
)
BANNER = re.compile(r"\s*/\*!\s*[\w.-]+ v?\d+\.\d")
COPY_PATH = (
    r"(^|/)(third[_-]?party|3rd[_-]?party|vendor|vendors|vendored|node_modules|bower_components|jspm_packages|deps|external|externals"
    r"|Pods|Carthage|site-packages|dist-packages|Godeps|upstream|extlib|lib/ext)/"
)
TOOL_NAME = r"(\.min\.|[.-]bundle\.js$|\.prod\.js$|[._](pb|pb2|gen|generated|mock|stub)\.[a-z]+$)"
TOOL_PATH = r"(^|/)(gen|generated|build/out|api/stubs|data|tables|assets|static/js|web/dist|public|dist)/"

FEATURES = (
    "compression", "entropy", "distinct_tokens", "identifier_length", "short_identifiers", "numbered_identifiers",
    "comment_density", "longest_line", "mean_line", "digit_share", "punctuation_share", "space_share", "literal_share",
    "line_shapes", "size",
)
#: Share of trees from which a file counts as machine-made; hand-written files stay under 0.1.
DECISION = 0.3
_HEAD = re.compile(r"\s*(?:(?://[^\n]*|#(?!\[)[^\n]*|/\*[\s\S]*?\*/)\s*)*")
_COMMENT = re.compile(r"//[^\n]*|(?m:^[ \t]*#(?!\[)[^\n]*)|/\*[\s\S]*?\*/|\"\"\"[\s\S]*?\"\"\"")
_TOKEN = re.compile(r"[^\W\d]\w*|\d[\w.]*|\"[^\"\n]*\"|'[^'\n]*'|[^\w\s]")
_SHAPE = str.maketrans({**dict.fromkeys("0123456789", "0"), **dict.fromkeys("abcdefghijklmnopqrstuvwxyz", "a"), **dict.fromkeys("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "A")})
_RUN = re.compile(r"[aA0_]+")


def heading(text: str) -> str:
    return _HEAD.match(text.removeprefix("﻿")).group()


def measure(text: str) -> list[float]:
    """The content measures of a file, its heading comment left out."""
    text = text.removeprefix("﻿").replace("\r\n", "\n")
    body = text[_HEAD.match(text).end() :]
    code = _COMMENT.sub(" ", body)
    size = max(1, len(code))
    raw = code.encode()
    counts = Counter(_TOKEN.findall(code))
    total = max(1, sum(counts.values()))
    entropy = -sum(n / total * math.log2(n / total) for n in counts.values())
    names = length = short = numbered = literal = 0
    for token, n in counts.items():
        first = token[0]
        if first.isalpha() or first == "_":
            names += n
            length += n * len(token)
            short += n * (len(token) <= 2)
            numbered += n * (not token.isalpha() and any(c.isdigit() for c in token))
        elif first.isdigit() or first in "\"'":
            literal += n
    lines = [line for line in code.split("\n") if line and not line.isspace()]
    n_lines = max(1, len(lines))
    shapes = len(set(_RUN.sub("a", code.translate(_SHAPE)).split("\n")))
    digits = sum(map(code.count, "0123456789"))
    spaces = code.count(" ") + code.count("\n") + code.count("\t")
    signs = sum(n for t, n in counts.items() if len(t) == 1 and not t.isalnum())
    return [
        len(zlib.compress(raw, 1)) / max(1, len(raw)), entropy / math.log2(total + 1), len(counts) / total,
        length / max(1, names), short / max(1, names), numbered / max(1, names),
        1 - len(code) / max(1, len(body)), math.log1p(max(map(len, lines), default=0)), math.log1p(size / n_lines),
        digits / size, signs / size, spaces / size, literal / total, shapes / n_lines, math.log1p(size),
    ]


_SCHEMA = "file_id long, tool_notice boolean, copy_notice boolean, banner boolean, " + ", ".join(f"{f} double" for f in FEATURES)


def _measure_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for file_id, content in zip(b.file_id, b.content):
            head = heading(content)
            rows.append((
                file_id, bool(TOOL_NOTICE.search(head)), bool(COPY_NOTICE.search(head)), bool(BANNER.match(head)), *measure(content),
            ))
        yield pd.DataFrame(rows, columns=["file_id", "tool_notice", "copy_notice", "banner", *FEATURES])


def measured_files(files: DataFrame, texts: DataFrame) -> DataFrame:
    """file_id, path, the notices and the content measures of every file with text."""
    sources = texts.where("content is not null and file_id is not null").where(~F.col("content").rlike(r"^\s*$")).select("file_id", "content")
    # Texts are measured where they lie; only the measures are joined.
    measured = spread(sources).mapInPandas(_measure_batches, _SCHEMA)
    paths = file_paths(files).select(F.col("id").alias("file_id"), F.col("absolute_path").alias("path"))
    return measured.join(paths, "file_id", "left")


def _fit(rows: DataFrame, leaf: int = 3):
    from pyspark.ml.classification import RandomForestClassifier

    forest = RandomForestClassifier(
        featuresCol="features", labelCol="label", numTrees=40, maxDepth=8, minInstancesPerNode=leaf, subsamplingRate=0.8, seed=7
    )
    return forest.fit(rows)


def _sample(rows: DataFrame, positive: int, negative: int) -> DataFrame:
    """At most MAX_TRAINING_ROWS of each label, by hash."""
    share = {1.0: min(1.0, MAX_TRAINING_ROWS / max(1, positive)), 0.0: min(1.0, MAX_TRAINING_ROWS / max(1, negative))}
    ticket = F.pmod(F.xxhash64("file_id"), F.lit(1_000_000)) / 1e6
    return rows.where(ticket < F.when(F.col("label") == 1.0, share[1.0]).otherwise(share[0.0]))


def judge_files(files: DataFrame, texts: DataFrame) -> DataFrame:
    """file_id, path, score (share of trees for machine-made), tool_notice, copied, found.

    Two passes: files without any label that a first forest takes for machine-made are no
    negatives of the second.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    measured = measured_files(files, texts)
    made = F.col("tool_notice") | F.col("banner") | F.coalesce(F.col("path").rlike(TOOL_NAME), F.lit(False))
    likely = F.coalesce(F.col("path").rlike(TOOL_PATH), F.lit(False))
    copied = F.col("copy_notice") | F.coalesce(F.col("path").rlike(COPY_PATH), F.lit(False))
    labelled = measured.withColumn("copied", copied).withColumn(
        "label", F.when(made | (likely & ~F.col("copied")), 1.0).when(~F.col("copied"), 0.0)
    )
    assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(labelled)
    rows = checkpoint(assembled.select("file_id", "path", "tool_notice", "banner", "copied", "label", "features"))
    counts = rows.agg(
        F.coalesce(F.sum(F.when(F.col("label") == 1.0, 1)), F.lit(0)), F.coalesce(F.sum(F.when(F.col("label") == 0.0, 1)), F.lit(0))
    ).first()
    if not min(counts):
        only = (F.col("label") == 1.0) | F.col("copied")
        return rows.select("file_id", "path", F.lit(None).cast("double").alias("score"), "tool_notice", "copied", F.coalesce(only, F.lit(False)).alias("found"))
    training = checkpoint(_sample(rows.where("label is not null"), *counts))
    score = vector_to_array("probability")[1]
    leaf = max(1, min(3, min(counts) // 20))  # with few labels a leaf must hold fewer rows
    first = _fit(training, leaf)
    clean = first.transform(training).where((F.col("label") == 1.0) & (score > 0.3) | (F.col("label") == 0.0) & (score < 0.5))
    clean = checkpoint(clean.select("file_id", "features", "label"))
    second = _fit(clean, leaf) if clean.select("label").distinct().count() == 2 else first
    return second.transform(rows).select(
        "file_id", "path", score.alias("score"), "tool_notice", "copied", ((score > DECISION) | F.col("copied")).alias("found")
    )


def foreign_files(files: DataFrame, texts: DataFrame) -> DataFrame:
    """file_id of the files that are not hand-written here."""
    return judge_files(files, texts).where("found").select("file_id")
