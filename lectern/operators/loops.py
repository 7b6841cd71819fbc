"""Loops around a language model: ask, validate, ask again.

The model is a callable ``chat(prompt) -> (answer, prompt_tokens,
completion_tokens)`` that the caller gives; it runs inside the partitions of
the worklist. What comes back is two tables, results and rejects, so that a
bad answer never stops a run and never becomes a row. The worklists are
anti-joins: a run that is repeated picks up where the last one ended.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import search as S
from . import vectors as R
from . import views as V

Chat = Callable[[str], tuple[str, int, int]]
Check = Callable[[str], list[str]]

class QuotaSpent(Exception):
    """A provider's quota is spent: the run ends, its rest stays to be done."""


ANSWER = "id long, answer string, attempts int, prompt_tokens long, completion_tokens long, seconds double, error string"


def ask(worklist: DataFrame, chat: Chat, check: Check, attempts: int = 3, most_errors: int = 3) -> DataFrame:
    """One row of ANSWER for each of worklist(id, prompt). A re-ask quotes
    what was wrong; tokens and seconds add up over attempts; error holds the
    last problems, or what the provider raised. After most_errors raised in a
    row, or when a quota is spent, a task stops asking; what it leaves has no
    row and stays on the worklist."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        failed = 0
        for batch in batches:
            rows = []
            for key, prompt in zip(*(c.to_pylist() for c in batch.columns)):
                if failed >= most_errors:
                    break
                used, got, cost, began, error, answer = 0, prompt, [0, 0], time.time(), None, None
                raised = False
                while used < attempts:
                    used += 1
                    try:
                        answer, sent, made = chat(got)
                    except QuotaSpent:
                        failed = most_errors
                        break
                    except Exception as why:  # a provider may raise anything; the row keeps what
                        error, raised = f"{type(why).__name__}: {why}", True
                        break
                    cost = [cost[0] + sent, cost[1] + made]
                    problems = check(answer)
                    error = "; ".join(problems) or None
                    if not problems:
                        break
                    got = f"{prompt}\n\nYour last answer was not valid: {error}. Answer again."
                if failed >= most_errors:
                    break
                failed = failed + 1 if raised else 0
                rows.append((key, None if error else answer, used, *cost, time.time() - began, error))
            cols = list(zip(*rows)) if rows else [()] * 7
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["id", "answer", "attempts", "prompt_tokens", "completion_tokens", "seconds", "error"])

    return worklist.select(F.col("id").cast("long").alias("id"), "prompt").mapInArrow(run, ANSWER)


def json_answer(text: str) -> dict | None:
    """The object between the first `{` and the last `}`."""
    m = re.search(r"\{.*\}", text or "", re.S)
    try:
        found = json.loads(m[0]) if m else None
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


def topics_check(vocabulary: list[str]) -> Check:
    known = set(vocabulary)

    def check(answer: str) -> list[str]:
        own = (json_answer(answer) or {}).get("topics")
        if not isinstance(own, list) or not 1 <= len(own) <= 4:
            return ["not 1 to 4 topics"]
        return ["a topic is repeated"] * (len(set(map(str, own))) < len(own)) + ["a topic is unknown"] * any(t not in known for t in own)

    return check


def summary_check(answer: str) -> list[str]:
    own = json_answer(answer)
    if own is None:
        return ["no JSON object"]
    line, findings, entities = own.get("one_liner"), own.get("key_findings"), own.get("entities")
    out = []
    if not isinstance(line, str) or not 0 < len(line.split()) <= 30:
        out.append("one-liner is not 1 to 30 words")
    if not isinstance(own.get("summary"), str) or not own["summary"].strip():
        out.append("summary is missing")
    if not isinstance(findings, list) or not 1 <= len(findings) <= 8 or any(not isinstance(x, str) or not x.strip() for x in findings):
        out.append("findings are not 1 to 8 texts")
    if not isinstance(entities, dict) or any(not isinstance(v, list) or any(not str(x).strip() for x in v) for v in entities.values()):
        out.append("entities are no lists of names")
    return out


def summaries(answers: DataFrame, model: str, prompt_version: str) -> DataFrame:
    """Valid answers as summary rows, candidates until promoted."""
    kind = "one_liner string, summary string, key_findings array<string>, entities map<string,array<string>>"
    parsed = answers.where("error IS NULL").withColumn("a", F.from_json(F.regexp_extract("answer", r"(?s)(\{.*\})", 1), kind))
    return parsed.select(F.col("id").alias("publication_id"), "a.*", F.lit(model).alias("model"), F.lit(prompt_version).alias("prompt_version"), "attempts", "prompt_tokens", "completion_tokens", "seconds")


def to_summarise(c: V.Catalog) -> DataFrame:
    """Texts with words and no primary summary."""
    return c["publication_text"].where("word_count > 0").join(V.primary(c), "publication_id", "left_anti")


def to_embed(pieces: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """Sections that are no furniture and lack a vector of this model."""
    own = vectors.where((F.col("model") == model) & (F.col("source_type") == "section")).select(F.col("source_id").alias("id"))
    return pieces.where("NOT is_boilerplate").join(own, "id", "left_anti")


def to_describe(c: V.Catalog, blurbs: DataFrame, stale: bool = False) -> DataFrame:
    """Primary summaries without a blurb; with stale, also those whose blurb
    was written from another summary."""
    own = blurbs.select("publication_id", "source_enrichment_id", F.lit(True).alias("there"))
    rows = V.primary(c).join(own, "publication_id", "left")
    missing = F.col("there").isNull()
    return rows.where(missing | ~F.col("source_enrichment_id").eqNullSafe(F.col("id")) if stale else missing).select("publication_id", "id")


def to_look_at(c: V.Catalog) -> DataFrame:
    """Publications only pictures can tell about: no summary, no words, no
    podcast, and either no PDF or chapters that carry the text."""
    p = c["publications"].where("pub_type <> 'Podcast'").join(V.primary(c).select(F.col("publication_id").alias("id")), "id", "left_anti")
    words = c["publication_text"].where("word_count > 0").select(F.col("publication_id").alias("id"))
    parents = c["publications"].where("parent_id IS NOT NULL").select(F.col("parent_id").alias("id")).distinct().withColumn("has_chapters", F.lit(True))
    return p.join(words, "id", "left_anti").join(parents, "id", "left").where("pdf_url IS NULL OR has_chapters").select("id")


def copies_of_executive_summaries(c: V.Catalog, sections: DataFrame, least: int = 150, long: int = 6000) -> DataFrame:
    """Long documents that already say it in an executive summary: its text,
    longest documents first."""
    own = sections.where(F.lower("heading").startswith("executive summary") & (F.col("word_count") >= least))
    first = own.groupBy("publication_id").agg(F.min_by(F.struct("id", "body", "word_count"), "position").alias("s"))
    texts = c["publication_text"].where(F.col("word_count") >= long).select("publication_id", F.col("word_count").alias("document_words"))
    return first.join(texts, "publication_id").select("publication_id", F.col("s.id").alias("section_id"), F.col("s.body").alias("body"), "document_words").orderBy(F.desc("document_words"), "publication_id")


def answer(question: str, excerpts: list[tuple[int, str]], chat: Chat) -> tuple[str, list[int], list[int]]:
    """(text, cited ids that were shown, cited ids that were not). With no
    excerpts the model is not asked."""
    if not excerpts:
        return "Nothing in this catalog matches the question.", [], []
    shown = "\n\n".join(f"[{i}] {re.sub(r'[\[\]]', ' ', text)}" for i, text in excerpts)
    text = chat(f"Answer from these excerpts only and cite them as [id].\n\n{shown}\n\nQuestion: {question}")[0]
    cited = dict.fromkeys(int(x) for m in re.findall(r"\[(\d+(?:\s*,\s*\d+)*)\]", text) for x in m.split(","))
    known = {i for i, _ in excerpts}
    return text, [i for i in cited if i in known], [i for i in cited if i not in known]


def answer_from(c: V.Catalog, index: S.Index | S.Scan, question: str, vectors: list, chat: Chat, limit: int = 10, section_words: int = 300, sections: S.Index | None = None) -> dict:
    """Retrieve by hybrid search, ask, and resolve citations. The excerpts
    are each hit's title, type, date, one-liner and best section, by the
    sections' index where one is given; else the sections are scanned."""
    hits, notes = R.hybrid(index, question, vectors, limit, c.get("shortlist"))
    pubs = c["publications"].select("id", "title", "pub_type", "date_published")
    rows = hits.join(pubs, "id").join(V.primary(c).select(F.col("publication_id").alias("id"), "one_liner"), "id", "left")
    found = {r.id: r for r in rows.orderBy("position").collect()}
    best = {}
    if "sections" in c and found and S.safe_query(question):
        ids = c["publications"].where(F.col("id").isin(list(found))).select("id")
        own = c["sections"].select("id", "publication_id", "heading", "body")
        try:
            found_in = sections or S.Scan(own.select("id", "heading", "body"), ("heading", "body"), index.stemmed)
            top = S.best_sections(found_in, own, S.safe_query(question), ids)
            best = {r.id: r for r in top.join(own.select(F.col("id").alias("section_id"), "heading", "body"), "section_id").collect()}
        except S.MatchError as why:
            notes.append(f"no sections ({why})")
    excerpts = []
    for i, r in found.items():
        lines = [f"{r.title}, {r.pub_type}, {r.date_published or 'undated'}", f"Summary: {r.one_liner or 'none, only the title is known'}"]
        if i in best:
            lines.append(f"{best[i].heading or ''}: {' '.join((best[i].body or '').split()[:section_words])}")
        excerpts.append((i, "\n".join(lines)))
    text, cited, unknown = answer(question, excerpts, chat)
    return {"question": question, "hits": list(found), "notes": notes, "text": text, "cited": cited, "invalid": unknown}


# HTTP statuses that are worth another try, and those of them
# that say a quota is spent.
RETRY_STATUS = frozenset({402, 408, 409, 425, 429, 500, 502, 503, 504, 529})
QUOTA_STATUS = frozenset({402, 429})
QUOTA_WAIT, QUOTA_MOST = 60.0, 900.0


def with_backoff(chat: Chat, tries: int = 5, wait: float = 5.0, sleep=time.sleep, end_on_quota: bool = False) -> Chat:
    """chat that waits out transient failures (timeouts, lost connections, and
    errors whose `status` is one of RETRY_STATUS), twice as long each time.
    Quotas are waited for in minutes, or with end_on_quota raise QuotaSpent at
    once; an error that says so itself (retry_after) is waited for as long as
    it says. Other errors are raised at once."""

    def call(prompt: str) -> tuple[str, int, int]:
        for turn in range(tries):
            try:
                return chat(prompt)
            except Exception as why:
                status = getattr(why, "status", None)
                if end_on_quota and status in QUOTA_STATUS:
                    raise QuotaSpent(str(why)) from why
                if turn == tries - 1 or not (isinstance(why, (TimeoutError, ConnectionError)) or status in RETRY_STATUS):
                    raise
                usual = min(QUOTA_MOST, QUOTA_WAIT * 2**turn) if status in QUOTA_STATUS else wait * 2**turn
                sleep(getattr(why, "retry_after", None) or usual)
        raise RuntimeError("no try was allowed")

    return call
