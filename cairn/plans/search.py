"""Queries of ranked search, with SQL that finds phrases by joining words with the words after them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import search as T
from .registry import query

#: Words of the documents that the queries name, with their places.
_WORDS = r"""w AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')) AS term, generate_subscripts(
  list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> ''), 1) AS p FROM {documents}),""".replace("{{", "{").replace("}}", "}")


def _any(terms: list[str]) -> str:
    return (f"SELECT doc_id, sum(0.1 / (n * n)) / 1.64493406685 / {len(terms)} AS rank FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id, term ORDER BY p) AS n FROM w "
            f"WHERE term IN ({', '.join(repr(t) for t in terms)})) WHERE n <= 256 GROUP BY doc_id")


def _all(terms: list[str]) -> str:
    return (f"""SELECT a.doc_id, 1 - product(1 - 0.1 * sqrt(CASE WHEN abs(a.p - b.p) > 100 THEN 1e-30 ELSE 1 / (1.005 + 0.05 * exp(abs(a.p - b.p) / 1.5 - 2)) END)) AS rank
        FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, term ORDER BY p) AS n FROM w WHERE term IN ({', '.join(repr(t) for t in terms)})) a
        JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id, term ORDER BY p) AS n FROM w WHERE term IN ({', '.join(repr(t) for t in terms)})) b
        ON a.doc_id = b.doc_id AND a.term < b.term WHERE a.n <= 256 AND b.n <= 256 GROUP BY a.doc_id""")


_index = lambda g: T.postings(g.documents, "doc_id", F.col("text"))
_ranked = lambda g, q: T.found(_index(g), "doc_id", q, g.documents).select("doc_id", F.round("rank", 6).alias("rank"))

query("x17_phrase", f"""WITH {_WORDS} r AS ({_all(["anea", "eriner", "the"])}) SELECT doc_id, round(rank, 6) AS rank FROM r WHERE doc_id IN
    (SELECT a.doc_id FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.p = a.p + 1 JOIN w c ON a.doc_id = c.doc_id AND c.p = a.p + 2 WHERE a.term = 'the' AND b.term = 'anea' AND c.term = 'eriner')""")(
    lambda g: _ranked(g, '"the anea eriner"'))
query("x17_or", f"""WITH {_WORDS} r AS ({_any(["die", "of", "que", "to", "und"])}), b AS (SELECT DISTINCT a.doc_id FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.p = a.p + 1 WHERE a.term = 'of' AND b.term = 'to')
    SELECT doc_id, round(rank, 6) AS rank FROM r WHERE (doc_id IN (SELECT doc_id FROM w WHERE term = 'die') AND doc_id NOT IN (SELECT doc_id FROM w WHERE term = 'und'))
    OR doc_id IN (SELECT doc_id FROM w WHERE term = 'que') OR doc_id IN (SELECT doc_id FROM b)""")(
    lambda g: _ranked(g, 'die -und OR Que or "of to"'))
query("x17_excluded", f"""WITH {_WORDS} x AS (SELECT DISTINCT doc_id FROM w WHERE term = 'the') SELECT doc_id, 0.0::DOUBLE AS rank FROM {{documents}} WHERE doc_id NOT IN (SELECT doc_id FROM x)""")(
    lambda g: _ranked(g, "-the"))
query("x17_ranked", f"""WITH {_WORDS} r AS ({_all(["and", "that", "with"])}), o AS (SELECT doc_id, round(rank, 6) AS rank, row_number() OVER (ORDER BY round(rank, 6) DESC, doc_id DESC)::INT AS place FROM r
    WHERE doc_id IN (SELECT doc_id FROM w WHERE term IN ('and', 'that', 'with') GROUP BY doc_id HAVING count(DISTINCT term) = 3)) SELECT * FROM o WHERE place <= 25""")(
    lambda g: T.first(T.found(_index(g), "doc_id", "that with and"), 25, F.desc("doc_id")).select("doc_id", F.round("rank", 6).alias("rank"), "place"))
query("x17_activities", """SELECT activity_id FROM {activity} WHERE project_id = 'proj3' AND (title LIKE '%Ticket   6 of %' OR event_type = 'purchase' AND title NOT LIKE '%Ticket   16 of %')""")(
    lambda g: (lambda a: T.found(T.postings(a, "activity_id", T.activity_text()), "activity_id", '"ticket 6 of" OR purchase -"ticket 16"').select("activity_id"))(
        g.activity.where("project_id = 'proj3'").withColumn("tags", F.array("owner"))))
query("x17_ilike_fallback", """SELECT activity_id, occurred_at FROM {activity} WHERE project_id = 'proj3' AND contains(lower(title || ' ' || summary || ' ' || owner), '6 of view')
    ORDER BY occurred_at DESC, source_item_id DESC, activity_id DESC LIMIT 25""")(
    lambda g: T.search_literal(g.activity.withColumn("tags", F.array("owner")), "proj3", "6 OF view").select("activity_id", "occurred_at"))
