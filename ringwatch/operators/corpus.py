"""Policy corpus: sections of pages, anchors, digests, citations and claims."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ringwatch.operators.ledger import SEPARATOR

MIN_WORDS, MAX_WORDS = 4, 15
CITED = r"\[([A-Za-z0-9._:-]+)\]"
_TITLE = re.compile(r"<title[^>]*>(.*?)</title>", re.IGNORECASE | re.DOTALL)


class _Sections(HTMLParser):
    """Text under each heading of the first three levels; list items that open in bold start their own."""

    BLOCKS = {"p", "li", "div", "ul", "ol", "td", "tr", "br", "blockquote"}
    SKIP, HEADS = {"script", "style", "noscript", "template"}, {"h1", "h2", "h3"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, list[str]]] = []
        self.head: list[str] | None = None
        self.skipped = self.lists = 0
        self.item = self.bold = False

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIP:
            self.skipped += 1
        elif tag in self.HEADS:
            self.head = []
        elif tag in ("ul", "ol"):
            self.lists += 1
        elif tag == "li":
            self.item = self.lists == 1
        elif tag in ("b", "strong") and self.item and self.out:
            self.head, self.bold, self.item = [], True, False

    def handle_endtag(self, tag):
        if tag in self.BLOCKS and self.out:
            self.out[-1][1].append(" ")
        if tag in self.SKIP:
            self.skipped = max(0, self.skipped - 1)
        elif tag in ("ul", "ol"):
            self.lists = max(0, self.lists - 1)
        elif self.head is not None and (tag in self.HEADS or self.bold and tag in ("b", "strong")):
            self.out.append((" ".join("".join(self.head).split()).rstrip(":"), []))
            self.head, self.bold = None, False

    def handle_data(self, data):
        if self.skipped:
            return
        if data.strip() and self.head is None:
            self.item = False
        if self.head is not None:
            self.head.append(data)
        elif self.out:
            self.out[-1][1].append(data)


def sections(pages: DataFrame, least: int = 3, most: int = 64) -> DataFrame:
    """(page_id, ordinal, heading, text) of pages; text before the first heading is dropped.

    A task turns ``most`` pages at a time into Python's strings, however many its batch holds, and passes their sections on before it takes the next.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, most):
                part, rows = batch.slice(start, most), []
                for page, html in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    parser = _Sections()
                    parser.feed(html or "")
                    parser.close()
                    found = [(h, " ".join("".join(t).split())) for h, t in parser.out]
                    rows += [(page, i, h, t) for i, (h, t) in enumerate((h, t) for h, t in found if h and len(t.split()) >= least)]
                yield pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int32(), pa.string(), pa.string()))], ["page_id", "ordinal", "heading", "text"])

    return pages.select("page_id", "html").mapInArrow(cut, "page_id long, ordinal int, heading string, text string")


def slug(heading: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(heading), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def anchored(clauses: DataFrame, doc: str, heading: str, ordinal: str) -> DataFrame:
    """Anchors: slugs, the second and later of a document with their number."""
    df = clauses.withColumn("slug", slug(F.col(heading)))
    n = F.row_number().over(Window.partitionBy(doc, "slug").orderBy(ordinal))
    return df.withColumn("anchor_id", F.when(n == 1, F.col("slug")).otherwise(F.concat_ws("-", "slug", n.cast("string"))))


def document_digest(clauses: DataFrame, doc: str, fields: list[str], ordinal: str) -> DataFrame:
    """SHA-256 over the clauses of each document in order."""
    cells = F.struct(F.col(ordinal).alias("o"), F.array(*[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]).alias("f"))
    rows = F.array_sort(F.collect_list(cells))
    return clauses.groupBy(doc).agg(F.sha2(F.array_join(F.flatten(F.transform(rows, lambda x: x["f"])), SEPARATOR), 256).alias("digest"))


def ambiguous(clauses: DataFrame, doc: str) -> DataFrame:
    """Anchors that more than one document has."""
    return clauses.groupBy("anchor_id").agg(F.count_distinct(doc).alias("documents")).where("documents > 1")


def words(text: Column) -> Column:
    t = F.trim(F.regexp_replace(text, r"[\x09-\x0D\x20]+", " "))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def quoted(text: Column, excerpt: Column) -> Column:
    """Whether the excerpt's words stand in the text in a row, whole words only; an empty excerpt never does."""
    plain = lambda c: F.trim(F.regexp_replace(c, r"[\x09-\x0D\x20]+", " "))
    pad = lambda c: F.concat(F.lit(" "), plain(c), F.lit(" "))
    return (plain(excerpt) != "") & pad(text).contains(pad(excerpt))


def _runs(words_: str, k: int) -> Column:
    """Hashes of all runs of ``k`` elements of an array of word hashes; none if it is shorter."""
    each = F.transform(words_, lambda x, i: F.xxhash64(F.lit(k), x, *[F.get(F.col(words_), i + j) for j in range(1, k)]))
    return F.slice(each, F.lit(1), F.greatest(F.size(words_) - (k - 1), F.lit(0)))


def quotations(documents: DataFrame, items: DataFrame, first: int = 8) -> DataFrame:
    """(doc_id, item_id): documents that quote the whole text of an item, word by word.

    Runs of as many words as an item begins with (``first``, or all it has) meet by their hashes, (doc_id, run) alone; the texts of what met are fetched
    after that, and the whole quotation is checked.
    """
    plain = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x09-\x0D\x20]+", " "))
    hashed = lambda df, text: df.withColumn("_h", F.transform(F.split(text, " "), lambda x: F.xxhash64(x)))
    quotes = items.select("item_id", plain(F.col("text")).alias("quote")).where("quote <> ''")
    heads = hashed(quotes, "quote").withColumn("size", F.least(F.size("_h"), F.lit(first)))
    sizes = sorted(r["size"] for r in heads.select("size").distinct().collect())  # at most `first` numbers
    run = F.coalesce(*[F.when(F.col("size") == k, F.get(_runs("_h", k), 0)) for k in sizes], F.lit(None).cast("long"))
    heads = heads.select("item_id", run.alias("run"))
    docs = documents.select("doc_id", plain(F.col("text")).alias("plain"))
    every = F.concat(*[_runs("_h", k) for k in sizes], F.array().cast("array<bigint>"))
    met = hashed(docs, "plain").select("doc_id", F.explode(F.array_distinct(every)).alias("run")).join(heads, "run").select("doc_id", "item_id").distinct()
    pad = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))
    both = met.join(docs, "doc_id").join(quotes, "item_id")
    return both.where(pad("plain").contains(pad("quote"))).select("doc_id", "item_id")


def resolve(citations: DataFrame, documents: DataFrame, clauses: DataFrame) -> DataFrame:
    """The first thing wrong with each (citation_id, content_digest, anchor_id, excerpt), or ``resolved``."""
    docs = documents.select("content_digest", F.lit(True).alias("_doc")).distinct()
    own = clauses.select("content_digest", "anchor_id", F.col("text").alias("_text"))
    df = citations.join(docs, "content_digest", "left").join(own, ["content_digest", "anchor_id"], "left")
    n = words(F.col("excerpt"))
    code = (
        F.when(F.col("_doc").isNull(), "unknown_document").when(F.col("_text").isNull(), "phantom_anchor").when(n > MAX_WORDS, "excerpt_too_long")
        .when(n < MIN_WORDS, "excerpt_too_short").when(~quoted(F.col("_text"), F.col("excerpt")), "excerpt_not_in_clause").otherwise("resolved")
    )
    return df.select("citation_id", code.alias("code"))


def cited(text: Column) -> Column:
    """Distinct ids in square brackets, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(CITED), F.lit(1))))


def claims(claims_: DataFrame, known: DataFrame) -> DataFrame:
    """Claims whose citations don't hold: none, or some that no (claim_id, evidence_id) resolves."""
    ids = claims_.select("claim_id", cited(F.col("text")).alias("ids"))
    each = ids.select("claim_id", F.explode("ids").alias("evidence_id"))
    lost = each.join(known, ["claim_id", "evidence_id"], "left_anti").groupBy("claim_id").agg(F.array_sort(F.collect_set("evidence_id")).alias("lost"))
    code = F.when(F.size("ids") == 0, "no_evidence_cited").when(F.col("lost").isNotNull(), "unresolvable_evidence_id").otherwise("verified")
    return ids.join(lost, "claim_id", "left").select("claim_id", code.alias("code"), F.coalesce(F.array_join("lost", ","), F.lit("")).alias("unresolved"))


def field_lines(text: Column, names: tuple[str, ...]) -> list[Column]:
    """The last ``NAME: value`` line of each name, null if there is none."""
    lines = F.split(text, "\n")
    last = lambda n: F.get(F.reverse(F.filter(lines, lambda x: x.startswith(f"{n}:"))), F.lit(0))
    return [F.trim(F.substring(last(n), F.lit(len(n) + 2), F.length(last(n)))).alias(n.lower()) for n in names]


LINE_ENDS = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"
ROLES = ("FACT", "GROUND", "MEASURE", "REDRESS")


def rationale_lines(outputs: DataFrame) -> DataFrame:
    """(output_id, case_id, line): lines of (output_id, text) that begin with a case's id and a colon; of several for one case the last."""
    lines = outputs.select("output_id", F.posexplode(F.split("text", LINE_ENDS)).alias("_at", "line")).withColumn("line", F.trim("line"))
    case = F.trim(F.split_part("line", F.lit(":"), F.lit(1)))
    own = lines.where(F.col("line").contains(":")).withColumn("case_id", case).where(F.col("case_id").startswith("case-"))
    return own.groupBy("output_id", "case_id").agg(F.max_by("line", "_at").alias("line"))


def rationale_checks(cases: DataFrame, lines: DataFrame, components: list[str]) -> DataFrame:
    """Whether each case's line cites evidence, and only that case's own components (``case_id:component``); a case without a line cites nothing."""
    text = cases.select("case_id").join(lines.select("case_id", "line"), "case_id", "left").select(F.col("case_id").alias("claim_id"), F.coalesce("line", F.lit("")).alias("text"))
    known = cases.select(F.col("case_id").alias("claim_id"), F.explode(F.array(*[F.concat_ws(":", "case_id", F.lit(c)) for c in components])).alias("evidence_id"))
    return claims(text, known).withColumnRenamed("claim_id", "case_id")


def draft_lines(drafts: DataFrame) -> DataFrame:
    """(memo_id, place, role, text, anchor, excerpt) of (memo_id, text): lines ``ROLE: body``; a GROUND's body has parts between bars, in any order.

    Lines without a known role or a body are dropped.
    """
    lines = drafts.select("memo_id", F.posexplode(F.split("text", LINE_ENDS)).alias("place", "line")).withColumn("line", F.trim("line"))
    role = F.upper(F.regexp_extract("line", f"(?i)^({'|'.join(ROLES)})\\s*:", 1))
    rows = lines.withColumn("role", role).where("role <> ''").withColumn("body", F.trim(F.regexp_replace("line", r"^[A-Za-z]+\s*:", ""))).where("body <> ''")
    parts = F.transform(F.split("body", "[|]"), lambda x: F.trim(x))
    named = lambda name: F.filter(parts, lambda x: x.rlike(f"(?i)^{name}\\s*="))
    field = lambda name: F.when((F.col("role") == "GROUND") & (F.size(named(name)) > 0), F.trim(F.regexp_replace(F.element_at(named(name), -1), r"^[A-Za-z]+\s*=", "")))
    rest = F.array_join(F.filter(parts, lambda x: ~x.rlike(r"(?i)^(anchor|excerpt)\s*=") & (x != "")), " ")
    return rows.select("memo_id", "place", "role", F.when(F.col("role") == "GROUND", rest).otherwise(F.col("body")).alias("text"), field("anchor").alias("anchor"), field("excerpt").alias("excerpt"))


def memo_faults(memos: DataFrame, lines: DataFrame, evidence: DataFrame, clauses: DataFrame) -> DataFrame:
    """(memo_id, place, code): every role a memo lacks (place -1), every FACT or citing line whose evidence does not hold, every GROUND whose citation does not.

    ``evidence``: memo_id, evidence_id; ``clauses``: anchor_id, text.
    """
    each = memos.select("memo_id", F.explode(F.array(*map(F.lit, ROLES))).alias("role"))
    lacking = each.join(lines.select("memo_id", "role").distinct(), ["memo_id", "role"], "left_anti").select("memo_id", F.lit(-1).alias("place"), F.concat(F.lit("lacks_"), F.lower("role")).alias("code"))
    key = F.struct("memo_id", "place")
    citing = lines.where((F.col("role") == "FACT") | (F.size(cited(F.col("text"))) > 0)).select(key.alias("claim_id"), "memo_id", "text")
    known = citing.select("claim_id", "memo_id").join(evidence, "memo_id").select("claim_id", "evidence_id")
    bad = claims(citing, known).where("code <> 'verified'").select("claim_id.memo_id", "claim_id.place", "code")
    grounds = lines.where("role = 'GROUND'")
    none = grounds.where("anchor IS NULL OR excerpt IS NULL").select("memo_id", "place", F.lit("no_citation").alias("code"))
    cites = grounds.where("anchor IS NOT NULL AND excerpt IS NOT NULL").select(key.alias("citation_id"), F.lit("corpus").alias("content_digest"), F.col("anchor").alias("anchor_id"), "excerpt")
    corpus = clauses.select(F.lit("corpus").alias("content_digest"), "anchor_id", "text")
    lost = resolve(cites, corpus, corpus).where("code <> 'resolved'").select("citation_id.memo_id", "citation_id.place", "code")
    return lacking.unionByName(bad).unionByName(none).unionByName(lost)


def attempt_summary(attempts: DataFrame) -> DataFrame:
    """Of each memo's attempts (memo_id, attempt, outcome, flags): how many were refused, how many different defects were found, and whether the agent ever changed its output."""
    flagged = F.when(F.size("flags") > 0, F.array_sort("flags"))
    kinds, held = F.count_distinct(flagged), F.count(flagged)
    defects = attempts.select("memo_id", F.explode("flags").alias("f")).groupBy("memo_id").agg(F.count_distinct("f").alias("distinct_defects"))
    out = attempts.groupBy("memo_id").agg(F.count_if(F.col("outcome") != "verified").alias("rejected_attempts"), ((kinds > 1) | ((held > 0) & (F.count_if(F.col("outcome") == "verified") > 0))).alias("revised"))
    return out.join(defects, "memo_id", "left").fillna(0, ["distinct_defects"])


def titles(pages: DataFrame, entities: tuple[tuple[str, str], ...] | None = None) -> DataFrame:
    """(page_id, title): the page's title as fetched, entities resolved and white space collapsed; empty if it has none.

    With ``entities``, pairs of (written, meant), only these are resolved, one after the other and as they are written (``&amp`` without its semicolon stays),
    only ASCII white space is collapsed, and a page without HTML has no title (null); all in JVM expressions.
    """
    if entities is not None:
        title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
        for written, meant in entities:
            title = F.replace(title, F.lit(written), F.lit(meant))
        return pages.select("page_id", F.trim(F.regexp_replace(title, r"[\t\n\f\r ]+", " ")).alias("title"))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [_TITLE.search(h or "") for h in frame["html"]]
            yield pd.DataFrame({"page_id": frame["page_id"], "title": [" ".join(unescape(m.group(1)).split()) if m else "" for m in found]})

    return pages.select("page_id", "html").mapInPandas(read, "page_id long, title string")


def kept_sections(found: DataFrame, drop_headings: tuple[str, ...] = (), least: int = 3) -> DataFrame:
    """Sections that become clauses: not under a dropped heading (in any case), and not too short."""
    drop = [h.strip().lower() for h in drop_headings]
    return found.where(~F.lower(F.trim("heading")).isin(drop) & (words(F.col("text")) >= least)) if drop else found.where(words(F.col("text")) >= least)


def named_callouts(found: DataFrame, names: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """Sections with callouts (``kind`` 'callout') under the headings of (match, heading), and everything that does not fit.

    Faults: a callout that no match or several fit, a match that fits no callout or several.
    """
    spark = found.sparkSession
    known = F.broadcast(spark.createDataFrame([(i, m, h) for i, (m, h) in enumerate(names)], "_i int, _match string, _heading string"))  # the operator's own list
    boxes = found.where("kind = 'callout'").select("page_id", "ordinal", "text")
    fits = boxes.join(known, F.col("text").contains(F.col("_match")))
    per_box = fits.groupBy("page_id", "ordinal").agg(F.count(F.lit(1)).alias("_n"), F.min("_heading").alias("_heading"))
    each = boxes.join(per_box, ["page_id", "ordinal"], "left").fillna(0, ["_n"])
    wrong = each.where("_n <> 1").select(F.when(F.col("_n") == 0, "unnamed_callout").otherwise("ambiguous_callout").alias("code"), F.concat_ws(":", "page_id", "ordinal").alias("subject"))
    used = known.join(fits.groupBy("_i").agg(F.count(F.lit(1)).alias("_n")), "_i", "left").fillna(0, ["_n"])
    stale = used.where("_n <> 1").select(F.when(F.col("_n") == 0, "unmatched_title").otherwise("repeated_title").alias("code"), F.col("_match").alias("subject"))
    heading = F.when(F.col("kind") == "callout", F.col("_heading")).otherwise(F.col("heading"))
    named = found.join(per_box.where("_n = 1").drop("_n"), ["page_id", "ordinal"], "left").withColumn("heading", heading).select(*found.columns)
    return named, wrong.unionByName(stale)


def tokens(text: Column) -> Column:
    """Rough number of tokens: a quarter of the characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")
