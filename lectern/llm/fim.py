"""Fill-in-middle: texts cut at two token ranks and put in another order.

A token is a run of A-Z and a-z or one other code point, so a byte begins one
if it leads a code point and is not a letter after a letter: a predicate of
two adjacent bytes. Texts are cut into chunks that see one byte before them;
each chunk counts its token starts by itself, prefix sums over a text's chunks
tell which chunk owns a rank, and only the owning chunks are read again to
find the byte. A text's bytes are never decoded or split into tokens, and no
text leaves its task: the plan is one scan without a shuffle. Memory is some
three times PIECE bytes besides the rows of an Arrow batch.

Null text: empty, plain. Null id: the draws of an empty id. Very long texts:
more chunks. Repeated rows: the same output each. Empty table: empty result.
Further columns pass, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base, buffers

PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
CHUNK = 4096
#: Bytes whose predicates are held at once.
PIECE = 1 << 20

_byte = np.arange(256)
LETTER = ((_byte >= 0x41) & (_byte <= 0x5A)) | ((_byte >= 0x61) & (_byte <= 0x7A))


def _starts(data: np.ndarray, lo: int, hi: int, first: np.ndarray) -> np.ndarray:
    """Flags of the token starts in data[lo:hi]; first are the first bytes of
    texts in there, which begin a token whatever is before them."""
    letter = LETTER[data[max(lo - 1, 0) : hi]]
    after = letter[:-1] if lo else np.concatenate([[False], letter[:-1]])
    found = buffers.LEADS[data[lo:hi]] & ~(letter[len(letter) - (hi - lo) :] & after)
    found[first - lo] = True
    return found


def cuts(data: np.ndarray, at: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each text, and for each of its draws (two or more columns of
    unsigned integers) the code points before rank draw % (tokens + 1)."""
    parts = -(-np.diff(at) // CHUNK)
    own = np.concatenate([[0], np.cumsum(parts)])  # a text's first chunk
    begin = np.repeat(at[:-1], parts) + CHUNK * (np.arange(own[-1]) - np.repeat(own[:-1], parts))
    end = np.minimum(begin + CHUNK, np.repeat(at[1:], parts))
    tokens, points = np.zeros(own[-1] + 1, np.int64), np.zeros(own[-1] + 1, np.int64)
    is_first = np.zeros(own[-1], bool)
    is_first[own[:-1][parts > 0]] = True
    step = max(1, PIECE // CHUNK)
    for i in range(0, own[-1], step):
        j = min(i + step, own[-1])
        lo, hi = int(begin[i]), int(end[j - 1])
        tokens[i + 1 : j + 1] = np.add.reduceat(_starts(data, lo, hi, begin[i:j][is_first[i:j]]).astype(np.int32), begin[i:j] - lo)
        points[i + 1 : j + 1] = np.add.reduceat(buffers.LEADS[data[lo:hi]].astype(np.int32), begin[i:j] - lo)
    np.cumsum(tokens, out=tokens)
    np.cumsum(points, out=points)
    total = tokens[own[1:]] - tokens[own[:-1]]
    rank = draws % (total + 1)[:, None]
    found = np.zeros(draws.shape, np.int64)
    owner = np.searchsorted(tokens, tokens[own[:-1]][:, None] + rank, "right") - 1
    for t, c in np.argwhere(rank > 0).tolist():
        r = int(rank[t, c])
        if r == total[t]:
            found[t, c] = points[own[t + 1]] - points[own[t]]
            continue
        k = int(owner[t, c])
        lo, hi = int(begin[k]), int(end[k])
        place = np.flatnonzero(_starts(data, lo, hi, begin[k : k + 1] if is_first[k] else begin[:0]))[tokens[own[t]] + r - tokens[k]]
        found[t, c] = points[k] - points[own[t]] + np.count_nonzero(buffers.LEADS[data[lo : lo + place]])
    return total, found


def draw(key: Column, seed: str, group: int) -> Column:
    """The group-th 8 hex digits of sha256(seed:key) as a long."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digest, 8 * group - 7, 8), 16, 10).cast("long")


def transformed(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: str = "1", rate: int = 90, spm: int = 20) -> tuple[DataFrame, list[str]]:
    """docs with five more columns, and their names: n_tokens, form (plain, psm
    or spm), prefix_chars, middle_chars (null if plain) and the output. rate
    and spm are in percent of all texts and of the changed ones."""
    names = base.fresh(docs, "n_tokens", "form", "prefix_chars", "middle_chars", "fim_text")
    h1, h2, n, a, b = base.fresh(docs, "h1", "h2", "n", "a", "b")
    own = F.col(base.quoted(key))
    rows = docs.select("*", draw(own, seed, 1).alias(h1), draw(own, seed, 2).alias(h2))
    width, at = len(rows.columns), docs.columns.index(text)
    plain_names = base.numbered(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, bounds in buffers.slices(batch, f"c{at}"):
                draws = np.stack([part.column(width - 2).to_numpy(), part.column(width - 1).to_numpy()], axis=1)
                total, found = cuts(data, bounds, draws)
                columns = [*part.columns[: width - 2], pa.array(total), pa.array(found.min(axis=1)), pa.array(found.max(axis=1))]
                yield pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(width + 1)])

    fields = [f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields)]
    cut = plain_names.mapInArrow(run, ", ".join([*fields, *[f"c{width - 2 + i} long" for i in range(3)]])).toDF(*docs.columns, n, a, b)
    body = F.coalesce(F.col(base.quoted(text)), F.lit(""))
    marked = F.lit(False)
    for m in MARKS:
        marked = marked | F.contains(body, F.lit(m))
    form = F.when((body == "") | marked | (draw(own, seed, 3) % 100 >= rate), F.lit("plain")).when(draw(own, seed, 4) % 100 < spm, F.lit("spm")).otherwise(F.lit("psm"))
    first, last = F.col(a), F.col(b)
    prefix = body.substr(F.lit(1), first.cast("int"))
    middle = body.substr((first + 1).cast("int"), (last - first).cast("int"))
    suffix = body.substr((last + 1).cast("int"), F.lit(2**31 - 1))
    formed = cut.withColumn(names[1], form)
    kind = F.col(names[1])
    output = (
        F.when(kind == "plain", body)
        .when(kind == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    )
    changed = kind != "plain"
    out = formed.select(*base.columns_of(docs), F.col(n).alias(names[0]), kind, F.when(changed, first).alias(names[2]), F.when(changed, last - first).alias(names[3]), output.alias(names[4]))
    return out, names


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. A changed text holds no mark, and
    no mark can begin inside another, so marks are found by looking."""
    parts = F.split(output, "<[PSM]>")
    return F.when(form == "plain", output).when(form == "psm", F.concat(parts[1], parts[3], parts[2])).otherwise(F.concat(parts[2], parts[3], parts[1]))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.table(spark, sf_dir, "documents").select("doc_id", "text")
    out, (n, form, prefix, middle, text) = transformed(docs)
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", F.col(n).alias("n"), form, prefix, middle, digest(F.col(text)).alias("output_sha256"), digest(restored(F.col(text), F.col(form))).alias("restored_sha256"))


OP11_SQL = """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
d AS (
  SELECT *, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS r1, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS r2,
         CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
              WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM t),
c AS (
  SELECT doc_id, x, n, form, array_to_string(u[1:least(r1, r2)], '') AS p, array_to_string(u[least(r1, r2) + 1:greatest(r1, r2)], '') AS m,
         array_to_string(u[greatest(r1, r2) + 1:], '') AS s FROM d)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(x) AS restored_sha256
FROM c
"""
