"""The registered queries in SQL, written apart from the DataFrame code."""

from __future__ import annotations

from tellers.plans.labelling import instructions
from tellers.schema import TOPIC_NAMES

_DOMAIN = """
ballot_type AS (
  SELECT DISTINCT CAST(substr(o_orderpriority, 1, 1) AS INT) AS id,
         substr(o_orderpriority, 3) AS type
  FROM orders),
vote_type AS (
  SELECT * FROM (VALUES (1, 'For'), (2, 'Against'), (3, 'Absent')) v(id, type)),
party AS (
  SELECT n_nationkey AS id, n_name AS abbreviation, r_name AS name
  FROM nation JOIN region ON n_regionkey = r_regionkey),
member AS (
  SELECT s_suppkey AS id, substr(s_name, 1, 8) AS first_name, substr(s_name, 10) AS last_name,
         p.abbreviation AS party_abbr, p.id AS party_id
  FROM supplier LEFT JOIN party p ON p.id = s_nationkey AND s_suppkey % 10 <> 0),
bill AS (
  SELECT c_custkey AS id, c_name AS title,
         CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS short_title,
         CASE WHEN c_custkey % 11 <> 0 THEN c_mktsegment || ' resume of ' || c_name END AS resume, 'L ' || CAST(c_custkey AS VARCHAR) AS number,
         c_nationkey AS type_id, c_nationkey % 5 AS period_id
  FROM customer),
segment AS (
  SELECT * FROM (VALUES (1, 'AUTOMOBILE'), (2, 'BUILDING'), (3, 'FURNITURE'),
                        (4, 'HOUSEHOLD'), (5, 'MACHINERY')) t(id, name)),
topic AS (
  SELECT DISTINCT CAST(segment.id AS BIGINT) AS id, name
  FROM customer JOIN segment ON name = c_mktsegment
  UNION ALL
  SELECT CAST(r_regionkey + 6 AS BIGINT) AS id, r_name AS name FROM region),
bill_topic AS (
  SELECT c_custkey AS bill_id, CAST(s.id AS BIGINT) AS topic_id
  FROM customer JOIN segment s ON s.name = c_mktsegment WHERE c_acctbal >= 0
  UNION ALL
  SELECT c_custkey AS bill_id, CAST(n_regionkey + 6 AS BIGINT) AS topic_id
  FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal >= 0),
ballot AS (
  SELECT o_orderkey AS id, CAST(o_orderkey % 1000 AS INT) AS number,
         CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS conclusion, o_orderstatus = 'F' AS passed,
         CASE WHEN o_orderkey % 5 = 0 THEN o_orderstatus || ' noted' END AS comment, o_orderdate AS held_at,
         CAST(substr(o_orderpriority, 1, 1) AS INT) AS type_id,
         CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_custkey END AS bill_id
  FROM orders),
shipped_vote AS (
  SELECT concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR),
                   CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR),
                   CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR)) AS id,
         l_orderkey AS ballot_id, l_suppkey AS member_id,
         CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS vote_type_id,
         l_shipdate
  FROM lineitem),
vote AS (SELECT id, ballot_id, member_id, vote_type_id FROM shipped_vote)"""

_LISTS = _DOMAIN + """,
topic_names AS (
  SELECT bill_id, list_sort(list_distinct(list(name))) AS names
  FROM (SELECT bill_id, (SELECT name FROM topic WHERE id = topic_id) AS name FROM bill_topic)
  WHERE name IS NOT NULL GROUP BY bill_id),
-- one card for each bill: its own columns and the names of its topics
card AS (
  SELECT id AS bill_id, number AS bill_number, title, short_title, resume, period_id,
         (SELECT names FROM topic_names n WHERE n.bill_id = bill.id) AS names
  FROM bill),
shown AS (
  SELECT id, number, passed, conclusion, comment, held_at, type_id,
         (SELECT type FROM ballot_type k WHERE k.id = type_id) AS ballot_type,
         card.* EXCLUDE (names), array_to_string(names, ', ') AS spaced,
         array_to_string(names, ',') AS plain
  FROM ballot LEFT JOIN card USING (bill_id)),
listed AS (
  SELECT id, number, passed, held_at, type_id, ballot_type, bill_id, bill_number, title,
         short_title, period_id, spaced AS topics FROM shown),
header AS (SELECT * EXCLUDE (spaced, plain), plain AS topics FROM shown),
-- counts are made of ids alone, and only known vote types are named
tally AS (
  SELECT ballot_id, member_id, vote_type_id, count(*) AS votes FROM vote
  WHERE EXISTS (SELECT 1 FROM vote_type WHERE id = vote_type_id) GROUP BY ALL),
type_name AS (SELECT id AS vote_type_id, type AS vote_type FROM vote_type),
total AS (
  SELECT ballot_id, vote_type_id, vote_type, votes::BIGINT AS votes FROM type_name JOIN (
    SELECT ballot_id, vote_type_id, sum(votes) AS votes FROM tally GROUP BY ALL) USING (vote_type_id)),
stat AS (
  SELECT member_id, vote_type, vote_type_id, votes::BIGINT AS votes FROM type_name JOIN (
    SELECT member_id, vote_type_id, sum(votes) AS votes FROM tally GROUP BY ALL) USING (vote_type_id)),
party_votes AS (
  SELECT ballot_id, party, vote_type_id, vote_type, votes::BIGINT AS votes FROM type_name JOIN (
    SELECT ballot_id, party, vote_type_id, sum(votes) AS votes
    FROM tally JOIN (SELECT id AS member_id, party_abbr AS party FROM member) USING (member_id)
    GROUP BY ALL) USING (vote_type_id)),
person_name AS (SELECT id AS member_id, first_name, last_name, party_abbr FROM member),
single_vote AS (
  SELECT vote.ballot_id, member_id, first_name, last_name, party_abbr, vote_type, vote_type_id
  FROM vote JOIN person_name USING (member_id) JOIN type_name USING (vote_type_id)),
named_member AS (
  SELECT id, first_name, last_name, party_abbr,
         (SELECT name FROM party WHERE party.id = party_id) AS party_name FROM member),
topic_stat AS (
  SELECT member_id, id AS topic_id, name AS topic, vote_type_id, vote_type, sum(votes)::BIGINT AS votes
  FROM topic, tally JOIN type_name USING (vote_type_id)
  WHERE EXISTS (
    SELECT 1 FROM bill_topic WHERE topic_id = topic.id
      AND bill_id = (SELECT bill_id FROM ballot WHERE ballot.id = ballot_id))
  GROUP BY ALL),
member_vote AS (
  SELECT member_id, cast_vote.id AS vote_id, ballot_id, held_at, passed, type_id, ballot_type, bill_number,
         title, short_title,
         (SELECT vote_type FROM type_name n WHERE n.vote_type_id = cast_vote.vote_type_id) AS vote_type,
         vote_type_id, topics, bill_id
  FROM vote AS cast_vote JOIN (SELECT * RENAME (id AS ballot_id) FROM header) USING (ballot_id))"""

_FEED = _DOMAIN + """,
place AS (
  SELECT n_nationkey, n_name, r_name, substr(n_name, 1, 8) AS code, n_regionkey,
         n_name || ' ' || r_name AS full_name
  FROM nation JOIN region ON n_regionkey = r_regionkey),
grp AS (
  SELECT n_nationkey + 10000000000 AS id,
         CASE WHEN n_nationkey = 24 THEN NULL WHEN n_nationkey = 23 THEN '' ELSE code END AS code,
         CASE WHEN n_nationkey % 5 = 2 OR n_nationkey = 3
              THEN trim(' Group ' || CASE WHEN n_nationkey = 7 THEN '' ELSE n_name END)
              ELSE r_name END AS name
  FROM place),
person AS (
  SELECT s_suppkey AS id, CASE WHEN s_suppkey % 13 = 0 THEN '' ELSE substr(s_name, 1, 8) END AS first_name,
         substr(s_name, 10) AS last_name,
         CASE WHEN s_suppkey % 10 = 0 THEN NULL WHEN s_suppkey % 11 = 0 THEN '' ELSE code END AS code,
         CASE WHEN s_suppkey % 10 <> 0 AND s_suppkey % 17 <> 0 THEN code END AS short,
         CASE WHEN s_suppkey % 10 <> 0 AND s_suppkey % 17 <> 0 AND s_suppkey % 4 <> 0
              THEN full_name END AS full_name
  FROM supplier JOIN place ON s_nationkey = n_nationkey),
built_member AS (
  SELECT p.id, first_name, last_name, code AS party_abbr,
         (SELECT max(g.id) FROM grp g WHERE g.code = p.code AND g.code <> '') AS party_id
  FROM person p),
old_party AS (
  SELECT CAST(n_nationkey AS BIGINT) AS id, code AS abbreviation, full_name AS name
  FROM place WHERE n_regionkey = 0),
seen_party AS (
  SELECT short AS abbreviation, min(id) AS arrival, arg_min(coalesce(full_name, short), id) AS name
  FROM person WHERE short IS NOT NULL GROUP BY short),
new_party AS (
  SELECT row_number() OVER (ORDER BY arrival) + (SELECT max(id) FROM old_party) AS id,
         abbreviation, name
  FROM seen_party s
  WHERE NOT EXISTS (SELECT 1 FROM old_party o
                    WHERE o.abbreviation = s.abbreviation AND o.name = s.name)),
all_party AS (SELECT * FROM old_party UNION ALL SELECT * FROM new_party),
raw_ballot AS (
  SELECT l_orderkey AS id, min(l_linenumber) AS number, max(l_linestatus) AS conclusion,
         max(l_returnflag) = 'R' AS passed, max(l_returnflag) AS flag
  FROM lineitem
  WHERE l_orderkey % 50 <> 0 AND l_orderkey % 51 <> 0 GROUP BY l_orderkey),
built_ballot AS (
  SELECT r.id, r.number, r.conclusion, r.passed, CASE WHEN r.number % 2 = 0 THEN flag END AS comment,
         o_orderdate AS held_at, r.number % 5 + 1 AS type_id,
         CASE WHEN o_orderkey % 97 <> 0 THEN o_custkey END AS bill_id
  FROM raw_ballot r JOIN orders ON o_orderkey = r.id
  WHERE o_orderdate >= TIMESTAMP '1998-01-01'
    AND NOT (o_orderstatus = 'P' AND o_orderpriority IN ('5-LOW', '2-HIGH')))"""

_LINES = """
line AS (
  SELECT l_orderkey, l_suppkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, l_shipdate
  FROM lineitem),
stored AS (
  SELECT * FROM line WHERE l_shipdate < TIMESTAMP '1998-01-01'
  QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_suppkey
    ORDER BY l_linenumber DESC, l_partkey DESC, l_extendedprice DESC) = 1)"""

_LABELS = """
doc_bill AS (
  SELECT doc_id AS id,
         CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN ''
              ELSE lang || ' ' || CAST(doc_id AS VARCHAR) END AS title,
         CASE WHEN doc_id % 3 <> 0 THEN source END AS short_title,
         CASE WHEN doc_id % 8 <> 0 THEN text END AS resume
  FROM documents),
open_bill AS (
  SELECT * FROM doc_bill b
  WHERE (title IS NOT NULL OR short_title IS NOT NULL)
    AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = b.id)),
item AS (
  SELECT (row_number() OVER (ORDER BY id) - 1) // 15 AS batch,
         (row_number() OVER (ORDER BY id) - 1) % 15 + 1 AS pos, id,
         CASE WHEN coalesce(title, '') <> '' THEN title
              ELSE coalesce(short_title, 'Uden titel') END AS shown,
         coalesce(nullif(resume, ''), short_title, '') AS body
  FROM open_bill),
readable AS (
  SELECT doc_id // 15 AS batch, doc_id AS bill_id, unnest([source, lang, 'Ukendt']) AS topic
  FROM documents WHERE (doc_id // 15) % 7 <> 0),
source_topic AS (
  SELECT DISTINCT CAST(substr(source, 4) AS BIGINT) + 1 AS id, source AS name
  FROM documents WHERE source <> 'src7'),
matched AS (
  SELECT batch, bill_id, t.id AS topic_id FROM readable JOIN source_topic t ON t.name = topic),
known AS (SELECT doc_id AS id FROM documents WHERE n_chars >= 400),
stored_label AS (
  SELECT d.doc_id AS bill_id, CAST(substr(source, 4) AS BIGINT) + 1 AS topic_id
  FROM documents d WHERE source <> 'src7'
    AND EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1))"""


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _document_json() -> str:
    """Ballot documents; at the scales checked here every ballot fits one part."""
    def nested(source: str, fields: str, order: str) -> str:
        pairs = ", ".join(f"'{f}': {f}" for f in fields.split())
        keys = ", ".join(f"{k} NULLS FIRST" for k in order.split())
        return f"(SELECT ballot_id, to_json(list({{{pairs}}} ORDER BY {keys})) AS j FROM {source} GROUP BY 1)"

    counts = nested("party_votes", "party vote_type_id vote_type votes", "party vote_type_id")
    totals = nested("total", "vote_type_id vote_type votes", "vote_type_id")
    fields = "party_abbr last_name member_id first_name vote_type vote_type_id"
    single = nested("single_vote", fields, fields)
    return f"""
SELECT h.* EXCLUDE (id), h.id AS ballot_id, 1::BIGINT AS part, 1::BIGINT AS parts,
       coalesce(p.j, '[]')::VARCHAR AS party_votes, coalesce(t.j, '[]')::VARCHAR AS totals,
       coalesce(v.j, '[]')::VARCHAR AS votes
FROM header h LEFT JOIN {counts} p ON p.ballot_id = h.id
LEFT JOIN {totals} t ON t.ballot_id = h.id LEFT JOIN {single} v ON v.ballot_id = h.id"""


_MEMBER_DOCUMENT = """
SELECT m.id AS member_id, first_name, last_name, party_abbr, party_name,
       coalesce(s.j, '[]')::VARCHAR AS stats, coalesce(t.j, '[]')::VARCHAR AS topic_stats
FROM named_member m
LEFT JOIN (SELECT member_id, to_json(list({'vote_type_id': vote_type_id, 'vote_type': vote_type,
             'votes': votes} ORDER BY vote_type_id)) AS j FROM stat GROUP BY 1) s
  ON s.member_id = m.id
LEFT JOIN (SELECT member_id, to_json(list({'topic': topic, 'topic_id': topic_id,
             'vote_type_id': vote_type_id, 'vote_type': vote_type, 'votes': votes}
             ORDER BY topic, topic_id, vote_type_id)) AS j FROM topic_stat GROUP BY 1) t
  ON t.member_id = m.id"""

_LAST = "max({0})"
_VOTED = "id IN (SELECT member_id FROM vote)"
_NAMES = "party_abbr NULLS FIRST, last_name, first_name, id"
_VOTE_ROW = "SELECT * EXCLUDE (bill_id) FROM member_vote"

_LIST_QUERIES = {
    "voting_parties": f"""SELECT DISTINCT m.party_abbr AS abbreviation, p.name
        FROM member m JOIN party p ON p.id = m.party_id
        WHERE m.{_VOTED} AND m.party_abbr IS NOT NULL""",
    "topics": "SELECT id, name FROM topic",
    "ballot_types": "SELECT id, type FROM ballot_type",
    "ballot_list": "SELECT * FROM listed",
    "ballots_by_topic": """SELECT * FROM listed
        WHERE bill_id IN (SELECT bill_id FROM bill_topic WHERE topic_id = 2)""",
    "ballots_by_type": "SELECT * FROM listed WHERE type_id = 3",
    "ballots_passed": "SELECT * FROM listed WHERE passed",
    "ballots_search": """SELECT * FROM listed WHERE lower(title) LIKE '%l 1_7%'
        OR lower(short_title) LIKE '%l 1_7%' OR lower(bill_number) LIKE '%l 1_7%'""",
    "ballots_between": """SELECT * FROM listed
        WHERE held_at >= TIMESTAMP '1996-03-01' AND held_at < TIMESTAMP '1997-03-01'""",
    "ballots_sorted": "SELECT * FROM listed ORDER BY short_title NULLS FIRST, id",
    "ballot_page_info": """SELECT count(*) AS total, 1 AS page, 50 AS per_page,
        CAST(ceil(count(*) / 50) AS BIGINT) AS pages FROM ballot WHERE NOT passed""",
    "ballot_page": "SELECT * FROM listed ORDER BY held_at DESC, id LIMIT 50 OFFSET 100",
    "ballot_page_by_title": """SELECT * FROM listed
        WHERE held_at >= TIMESTAMP '1997-01-01' AND (lower(title) LIKE '%furn%'
          OR lower(short_title) LIKE '%furn%' OR lower(bill_number) LIKE '%furn%')
        ORDER BY short_title NULLS FIRST, id LIMIT 20 OFFSET 20""",
    "ballot_header": "SELECT * FROM header",
    "ballot_party_votes": "SELECT * FROM party_votes",
    "ballot_votes": "SELECT * FROM single_vote",
    "ballot_totals": "SELECT * FROM total",
    "ballot_page_far": "SELECT * FROM listed ORDER BY held_at DESC, id LIMIT 50 OFFSET 950",
    "member_votes_page_far": f"{_VOTE_ROW} ORDER BY held_at DESC, vote_id LIMIT 50 OFFSET 2000",
    "ballot_document": _document_json(),
    "ballot_document_bucketed": _document_json(),
    "ballot_document_parts": """SELECT id AS ballot_id, greatest(1, (n + 2) // 3)::BIGINT AS parts,
        1::BIGINT AS headers, n AS counted, n AS votes
        FROM (SELECT id, (SELECT count(*) FROM vote WHERE ballot_id = ballot.id) AS n FROM ballot)""",
    "voting_members": f"SELECT * FROM named_member WHERE {_VOTED}",
    "member_search": f"""SELECT * FROM named_member WHERE {_VOTED}
        AND (lower(first_name) LIKE '%er 0000000_1%' OR lower(last_name) LIKE '%er 0000000_1%'
          OR lower(first_name || ' ' || last_name) LIKE '%er 0000000_1%'
          OR lower(party_abbr) LIKE '%er 0000000_1%')
        ORDER BY {_NAMES} LIMIT 50""",
    "member_search_indexed": f"""SELECT * FROM named_member WHERE {_VOTED}
        AND (lower(first_name) LIKE '%er 0000000_1%' OR lower(last_name) LIKE '%er 0000000_1%'
          OR lower(first_name || ' ' || last_name) LIKE '%er 0000000_1%'
          OR lower(party_abbr) LIKE '%er 0000000_1%')
        ORDER BY {_NAMES} LIMIT 50""",
    "member_search_all": f"""SELECT * FROM named_member WHERE {_VOTED}
        AND (first_name LIKE '%1%' OR last_name LIKE '%1%' OR party_abbr LIKE '%1%')""",
    "one_ballot_document": f"{_document_json()} WHERE h.id = (SELECT {_LAST.format('o_orderkey')} FROM orders)",
    "one_member_document": f"{_MEMBER_DOCUMENT} WHERE m.id = (SELECT {_LAST.format('s_suppkey')} FROM supplier)",
    "one_member_votes_page": f"""{_VOTE_ROW} WHERE member_id = (SELECT {_LAST.format('s_suppkey')} FROM supplier)
        ORDER BY held_at DESC, vote_id LIMIT 50""",
    "member_header": "SELECT * FROM named_member",
    "ballots_search_indexed": """SELECT * FROM listed WHERE lower(title) LIKE '%l 1_7%'
        OR lower(short_title) LIKE '%l 1_7%' OR lower(bill_number) LIKE '%l 1_7%'""",
    "ballots_search_title_indexed": """SELECT * FROM listed WHERE passed AND (lower(title) LIKE '%furnitur%'
        OR lower(short_title) LIKE '%furnitur%' OR lower(bill_number) LIKE '%furnitur%')""",
    "member_votes_search_indexed": f"""{_VOTE_ROW} WHERE passed AND vote_type_id = 1
        AND (lower(title) LIKE '%build%' OR lower(short_title) LIKE '%build%')""",
    "member_stats_kept": "SELECT * FROM stat",
    "member_topic_stats_kept": "SELECT * FROM topic_stat",
    "incremental_append": """SELECT id, ballot_id, member_id, vote_type_id FROM shipped_vote
        WHERE ballot_id NOT IN (SELECT ballot_id FROM shipped_vote WHERE l_shipdate < TIMESTAMP '1996-01-01')""",
    "store_upsert": """SELECT * REPLACE (CASE WHEN id % 3 = 0 AND id <= 50 THEN title || ' B' ELSE title END AS title) FROM bill
        UNION ALL SELECT * REPLACE (id + 7000000 AS id) FROM bill WHERE id % 10 = 0""",
    "stream_last_fetched": """SELECT o_orderkey AS id, o_orderkey AS ballot_id, o_custkey AS member_id,
        CASE WHEN o_orderkey % 4 = 0 THEN 1 WHEN o_orderkey % 2 = 0 THEN 2 ELSE 9 END AS vote_type_id FROM orders""",
    "member_stats": "SELECT * FROM stat",
    "member_stats_by_id": "SELECT member_id, vote_type_id AS id, vote_type AS type, votes FROM stat",
    "member_topic_stats": "SELECT * FROM topic_stat",
    "member_document": _MEMBER_DOCUMENT,
    "member_votes": _VOTE_ROW,
    "member_votes_filtered": f"""{_VOTE_ROW} WHERE type_id = 2 AND passed AND vote_type_id = 1
        AND bill_id IN (SELECT bill_id FROM bill_topic WHERE topic_id = 7)
        AND (lower(title) LIKE '%u%' OR lower(short_title) LIKE '%u%')""",
    "member_votes_page": f"{_VOTE_ROW} ORDER BY held_at DESC, vote_id LIMIT 50 OFFSET 50",
    "member_votes_page_info": """SELECT member_id, count(*) AS total, 1 AS page, 50 AS per_page,
        CAST(ceil(count(*) / 50) AS BIGINT) AS pages
        FROM vote JOIN ballot ON ballot.id = ballot_id WHERE vote_type_id = 2 GROUP BY member_id""",
    "table_counts": " UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", count(*) AS \"rows\" FROM {t}"
        for t in ("ballot_type", "vote_type", "party", "member", "bill", "topic", "ballot", "vote")
    ),
    "incremental_votes": """SELECT id, ballot_id, member_id, vote_type_id FROM shipped_vote
        WHERE l_shipdate < TIMESTAMP '1996-01-01' OR ballot_id NOT IN (
          SELECT ballot_id FROM shipped_vote WHERE l_shipdate < TIMESTAMP '1996-01-01')""",
    "stream_votes": "SELECT * FROM vote",
    "rejected_votes": """SELECT * FROM (SELECT *, CASE
          WHEN member_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) THEN 'member'
          WHEN vote_type_id = 2 THEN 'vote_type' END AS reason FROM vote) WHERE reason IS NOT NULL""",
    "rejected_ballots": """SELECT * FROM (SELECT id, type_id, bill_id, CASE
          WHEN type_id = 4 THEN 'ballot_type' WHEN bill_id % 10 = 5 THEN 'bill' END AS reason
        FROM ballot) WHERE reason IS NOT NULL""",
    "sample_members": """SELECT first_name, last_name, party_abbr, party_name FROM named_member
        WHERE party_abbr IS NOT NULL ORDER BY md5('7/' || id) LIMIT 10""",
    "sample_bills": """SELECT id, number, short_title FROM bill WHERE number IS NOT NULL
        ORDER BY id LIMIT 5""",
}

_CONSTRAINTS = """,
member2 AS (
  SELECT m.id, first_name, CASE WHEN party_id <> 3 THEN last_name END AS last_name, party_id
  FROM member m JOIN supplier ON s_suppkey = m.id WHERE s_acctbal >= 0),
bill2 AS (SELECT c_custkey AS id FROM customer WHERE c_acctbal < 5000),
vote2 AS (
  SELECT concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR)) AS id,
         l_orderkey AS ballot_id, l_suppkey AS member_id,
         CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 END AS vote_type_id
  FROM lineitem)
"""


def _constraint_sql() -> str:
    def row(table: str, rule: str, count: str) -> str:
        return f"SELECT '{table}' AS \"table\", '{rule}' AS rule, CAST(({count}) AS BIGINT) AS violations"

    def unique(table: str, source: str, key: str) -> str:
        inner = f"SELECT {key} FROM {source} GROUP BY {key} HAVING count(*) > 1"
        return row(table, f"unique {key}", f"SELECT count(*) FROM ({inner}) u")

    def required(table: str, source: str, column: str) -> str:
        return row(table, f"required {column}", f"SELECT count(*) FROM {source} WHERE {column} IS NULL")

    def reference(table: str, source: str, column: str, target: str, target_source: str) -> str:
        return row(
            table, f"reference {column} to {target}",
            f"SELECT count(*) FROM {source} x WHERE x.{column} IS NOT NULL "
            f"AND NOT EXISTS (SELECT 1 FROM {target_source} y WHERE y.id = x.{column})",
        )

    rows = [
        unique("ballot_type", "ballot_type", "id"), required("ballot_type", "ballot_type", "type"),
        unique("vote_type", "vote_type", "id"), required("vote_type", "vote_type", "type"),
        unique("party", "party", "id"), required("party", "party", "abbreviation"),
        unique("member", "member2", "id"), required("member", "member2", "first_name"),
        required("member", "member2", "last_name"),
        reference("member", "member2", "party_id", "party", "party"),
        unique("bill", "bill2", "id"),
        unique("topic", "topic", "id"), unique("topic", "topic", "name"),
        required("topic", "topic", "name"),
        unique("bill_topic", "bill_topic", "bill_id, topic_id"),
        reference("bill_topic", "bill_topic", "bill_id", "bill", "bill2"),
        reference("bill_topic", "bill_topic", "topic_id", "topic", "topic"),
        unique("ballot", "ballot", "id"),
        reference("ballot", "ballot", "type_id", "ballot_type", "ballot_type"),
        reference("ballot", "ballot", "bill_id", "bill", "bill2"),
        unique("vote", "vote2", "id"), required("vote", "vote2", "ballot_id"),
        required("vote", "vote2", "member_id"), required("vote", "vote2", "vote_type_id"),
        reference("vote", "vote2", "ballot_id", "ballot", "ballot"),
        reference("vote", "vote2", "member_id", "member", "member2"),
        reference("vote", "vote2", "vote_type_id", "vote_type", "vote_type"),
    ]
    return f"WITH {_DOMAIN}{_CONSTRAINTS}" + "\nUNION ALL ".join(rows)


_FEED_QUERIES = {
    "read_by_ids": """SELECT id, title AS titel, short_title AS titelkort, resume, number AS nummer,
        type_id AS typeid, period_id AS periodeid FROM bill
        WHERE id IN (SELECT bill_id FROM ballot WHERE held_at >= TIMESTAMP '2000-06-01')""",
    "build_parties": """SELECT id, coalesce(nullif(code, ''), CAST(id AS VARCHAR)) AS abbreviation,
        name FROM grp""",
    "build_members": "SELECT * FROM built_member",
    "build_ballots": "SELECT * FROM built_ballot",
    "build_bills": "SELECT * FROM bill WHERE id IN (SELECT bill_id FROM built_ballot WHERE bill_id <> 0)",
    "xml_party": """SELECT id, short, full_name AS "full" FROM person
        UNION ALL SELECT id, NULL, NULL FROM grp""",
    "xml_party_codes": "SELECT DISTINCT short FROM person WHERE short IS NOT NULL",
    "xml_party_dim": "SELECT * FROM all_party",
    "repair_members": """SELECT m.id, m.first_name, m.last_name,
        coalesce(p.short, m.party_abbr) AS party_abbr,
        CASE WHEN p.short IS NULL THEN m.party_id ELSE coalesce(
          (SELECT min(a.id) FROM all_party a
           WHERE a.abbreviation = p.short AND a.name = coalesce(p.full_name, p.short)),
          (SELECT min(a.id) FROM all_party a WHERE a.abbreviation = p.short)) END AS party_id
        FROM built_member m JOIN person p ON p.id = m.id""",
    "repair_numbers": """SELECT b.id, title, short_title, resume,
        CASE WHEN c_acctbal < 0 THEN number WHEN c_nationkey % 6 = 0 THEN NULL
             ELSE 'B ' || CAST(b.id AS VARCHAR) END AS number, type_id, period_id
        FROM bill b JOIN customer ON c_custkey = b.id""",
    "numbered_bills": """SELECT count(*) FILTER (WHERE c_acctbal >= 0 AND c_nationkey % 6 <> 0)
        AS numbered, count(*) AS bills FROM customer""",
}

_PLAIN_QUERIES = {
    "ingest_pages": "SELECT event_id, ts, user_id, event_type, value, props FROM events",
    "ingest_completeness": """SELECT count(DISTINCT event_id // 100) AS pages, 0::BIGINT AS damaged,
        count(*) AS records, count(*) AS declared, true AS complete FROM events""",
    "ingest_completeness_damaged": """SELECT count(DISTINCT page) AS pages,
        count(DISTINCT page) FILTER (hurt) AS damaged, count(*) FILTER (NOT hurt) AS records,
        CASE WHEN count(*) > 0 THEN count(*) END AS declared, false AS complete
        FROM (SELECT event_id // 100 AS page, event_id // 100 % 7 IN (0, 3) AS hurt FROM events)""",
    "stream_completeness": """SELECT count(DISTINCT page) AS pages,
        count(DISTINCT page) FILTER (hurt) AS damaged, count(*) FILTER (NOT hurt) AS records,
        CASE WHEN count(*) > 0 THEN count(*) END AS declared, false AS complete
        FROM (SELECT event_id // 100 AS page, event_id // 100 % 7 IN (0, 3) AS hurt FROM events)""",
    "rejected_pages": "SELECT DISTINCT event_id // 100 AS page FROM events WHERE event_id // 100 % 7 IN (0, 3)",
    "stream_rejected_pages": "SELECT DISTINCT event_id // 100 AS page FROM events WHERE event_id // 100 % 7 IN (0, 3)",
    "upsert_last_wins": f"""WITH {_LINES}
        SELECT * FROM (SELECT *, l_shipdate >= TIMESTAMP '1998-01-01' AS late FROM line
          QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY late DESC,
            l_linenumber DESC, l_partkey DESC, l_extendedprice DESC) = 1)""".replace(
        "SELECT * FROM (", "SELECT * EXCLUDE (late) FROM ("),
    "insert_ignore": f"""WITH {_LINES}
        SELECT * FROM stored UNION ALL
        SELECT * FROM (SELECT * FROM line b WHERE l_shipdate >= TIMESTAMP '1998-01-01'
          AND NOT EXISTS (SELECT 1 FROM stored s
            WHERE s.l_orderkey = b.l_orderkey AND s.l_suppkey = b.l_suppkey)
          QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_suppkey
            ORDER BY l_linenumber, l_partkey, l_extendedprice) = 1)""",
    "lookup_load": """SELECT DISTINCT CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS id,
        substr(o_orderpriority, 3) AS type FROM orders
        UNION ALL SELECT DISTINCT CAST(substr(o_orderpriority, 1, 1) AS BIGINT) + 4,
        'OLD ' || substr(o_orderpriority, 3) FROM orders
        WHERE CAST(substr(o_orderpriority, 1, 1) AS BIGINT) > 1""",
    "load_progress": """SELECT 'user:' || CAST(user_id AS VARCHAR) AS key,
        arg_max(event_type, event_id) AS value FROM events GROUP BY user_id""",
    "constraint_report": _constraint_sql(),
    "append_report": """WITH numbered AS (
          SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS ballot_id, l_suppkey AS member_id,
                 CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 END AS vote_type_id, l_shipdate FROM lineitem),
        stored AS (SELECT id FROM numbered WHERE l_shipdate < TIMESTAMP '1997-01-01'),
        fresh AS (SELECT * FROM numbered WHERE l_shipdate >= TIMESTAMP '1997-01-01')
        SELECT 'vote' AS "table", rule, CAST(n AS BIGINT) AS violations FROM (
          SELECT 'unique id' AS rule, (SELECT count(*) FROM (SELECT id FROM fresh GROUP BY id
            HAVING count(*) > 1 OR id IN (SELECT id FROM stored))) AS n
          UNION ALL SELECT 'required ballot_id', (SELECT count(*) FROM fresh WHERE ballot_id IS NULL)
          UNION ALL SELECT 'required member_id', (SELECT count(*) FROM fresh WHERE member_id IS NULL)
          UNION ALL SELECT 'required vote_type_id', (SELECT count(*) FROM fresh WHERE vote_type_id IS NULL)
          UNION ALL SELECT 'reference ballot_id to ballot', (SELECT count(*) FROM fresh
            WHERE ballot_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'))
          UNION ALL SELECT 'reference member_id to member', (SELECT count(*) FROM fresh
            WHERE member_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0))
          UNION ALL SELECT 'reference vote_type_id to vote_type', (SELECT count(*) FROM fresh WHERE vote_type_id = 2))""",
}


def _topic_seed() -> str:
    seeds = ", ".join(f"({i}, {_text(name)})" for i, name in enumerate(TOPIC_NAMES, 1))
    return f"""WITH {_DOMAIN},
        held AS (SELECT DISTINCT CAST(s.id AS BIGINT) AS id, CASE c_mktsegment WHEN 'BUILDING' THEN 'Bolig'
            WHEN 'MACHINERY' THEN 'Energi' ELSE c_mktsegment END AS name
          FROM customer JOIN segment s ON s.name = c_mktsegment),
        seed AS (SELECT * FROM (VALUES {seeds}) v(pos, name))
        SELECT id, name FROM held UNION ALL
        SELECT row_number() OVER (ORDER BY pos) + (SELECT max(id) FROM held), name
        FROM seed WHERE name NOT IN (SELECT name FROM held)"""


_LABEL_QUERIES = {
    "unlabelled_bills": "SELECT * FROM open_bill",
    "prompt_batches": f"""SELECT batch, count(*) AS bills, {_text(instructions())} || string_agg(
          pos || '. [id=' || id || '] ' || shown || chr(10) || '   Resume: ' ||
          CASE WHEN length(body) > 300 THEN substr(body, 1, 300) || '...' ELSE body END ||
          chr(10) || chr(10), '' ORDER BY pos) AS prompt
        FROM item GROUP BY batch""",
    "label_batches": """SELECT batch,
        CASE WHEN min(id) % 7 <> 0 THEN '[' || string_agg('{"sag_id":' || id ||
          ',"kategorier":["len' || length(shown) || '"]}', ',' ORDER BY pos) || ']' END AS response,
        CASE WHEN min(id) % 7 = 0 THEN 'no answer for ' || min(id) END AS error
        FROM item GROUP BY batch""",
    "label_batches_retried": """SELECT batch,
        CASE WHEN min(id) % 7 <> 0 THEN '[' || string_agg('{"sag_id":' || id ||
          ',"kategorier":["len' || length(shown) || '"]}', ',' ORDER BY pos) || ']' END AS response,
        CASE WHEN min(id) % 7 = 0 THEN 'no answer for ' || min(id) END AS error
        FROM item GROUP BY batch""",
    "parse_responses": "SELECT * FROM readable",
    "rejected_responses": """SELECT DISTINCT doc_id // 15 AS batch FROM documents
        WHERE (doc_id // 15) % 7 = 0""",
    "ingest_labels": """SELECT * FROM stored_label UNION ALL
        SELECT DISTINCT bill_id, topic_id FROM matched m
        WHERE bill_id IN (SELECT id FROM known) AND NOT EXISTS (SELECT 1 FROM stored_label s
          WHERE s.bill_id = m.bill_id AND s.topic_id = m.topic_id)""",
    "orphan_labels": "SELECT * FROM matched WHERE bill_id NOT IN (SELECT id FROM known)",
    "label_counts": "SELECT batch, count(*) AS labels FROM matched GROUP BY batch",
}


def oracle_sql() -> dict[str, str]:
    return {
        **{name: f"WITH {_LISTS}\n{sql}" for name, sql in _LIST_QUERIES.items()},
        **{name: f"WITH {_FEED}\n{sql}" for name, sql in _FEED_QUERIES.items()},
        **{name: f"WITH {_LABELS}\n{sql}" for name, sql in _LABEL_QUERIES.items()},
        **_PLAIN_QUERIES,
        "topic_seed": _topic_seed(),
    }
