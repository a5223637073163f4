"""Queries of the general data problems, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.common import stored
from quire.operators import changes, hierarchy
from quire.sources import delimited


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.hierarchy(table(spark, sf_dir, "exported_docs"))


def p2_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.path_pieces(table(spark, sf_dir, "exported_docs"))


def _asked(pieces: DataFrame) -> DataFrame:
    """The query set: ids divisible by 20, against all rows."""
    return pieces.where("id % 20 = 0").select("id")


def p2_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = stored(p2_paths(spark, sf_dir), "pieces")
    return hierarchy.ancestors(pieces, _asked(pieces))


def p2_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = stored(p2_paths(spark, sf_dir), "pieces")
    return hierarchy.descendants(pieces, _asked(pieces))


def p2_descendant_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.descendant_counts(table(spark, sf_dir, "exported_docs"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = changes.apply_changes(table(spark, sf_dir, "doc_records"), table(spark, sf_dir, "index_updates"))
    return changes.current(state).select(F.col("doc_id").alias("new_doc_id"), F.col("seq").alias("commit_seq"))


def p4_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, feed = table(spark, sf_dir, "doc_records"), table(spark, sf_dir, "index_updates")
    now = changes.current(changes.apply_changes(base, feed)).select("doc_id", "seq")
    return changes.current_documents(base, feed, now)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delimited.rejects(table(spark, sf_dir, "customer_lines"))


def p5_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delimited.valid(table(spark, sf_dir, "customer_lines"))


def _sql_p5(tail: str) -> str:
    seps = {"','": ",", "';'": ";", "'|'": "|", "chr(9)": "\t"}
    field = lambda s: f'"(?:[^"]|"")*"|[^"{s}]*'
    esc = lambda s: s if s in ",;\t" else "\\" + s
    whens = lambda f: "CASE sep_char " + " ".join(f"WHEN {k} THEN {f(s)}" for k, s in seps.items()) + " END"
    sound = whens(lambda s: f"regexp_full_match(raw_line, '(?s)(?:{field(s)})(?:{esc(s)}(?:{field(s)}))*')")
    cells = whens(lambda s: f"regexp_extract_all({'chr(9)' if s == chr(9) else repr(s)} || raw_line, '(?s){esc(s)}({field(s)})', 1)")
    label = "[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
    host = rf"{label}(?:\.{label})+"
    piece = "[A-Za-z0-9_+-]+"
    return rf"""
        WITH a AS (SELECT line_no, {sound} AS sound, {cells} AS cells FROM customer_lines),
        b AS (SELECT line_no, sound, len(cells) AS n, list_transform(cells, lambda x: CASE WHEN x LIKE '"%' THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END) AS c FROM a),
        t AS (SELECT *, list_transform(c, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS v FROM b),
        r AS (SELECT line_no, c, CASE WHEN NOT sound THEN 'quoting' WHEN n <> 11 THEN 'columns'
            WHEN NOT regexp_full_match(v[1], '[0-9A-Fa-f]{{15}}') THEN 'id'
            WHEN v[9] <> '' AND NOT regexp_full_match(v[9], '{piece}(?:\.{piece})*@{host}') THEN 'email'
            WHEN v[10] <> '' AND (NOT regexp_full_match(v[10], '\d{{4}}-\d{{2}}-\d{{2}}') OR try_cast(v[10] AS DATE) IS NULL) THEN 'subsdate'
            WHEN v[11] <> '' AND NOT regexp_full_match(v[11], 'https?://{host}(?::\d{{1,5}})?(?:[/?#]\S*)?') THEN 'website' END AS reason FROM t)
        {tail}"""


_SQL_P2 = """
    WITH RECURSIVE e AS (SELECT id, max(CASE WHEN previous_id > 0 THEN previous_id ELSE -1 END) AS p FROM exported_docs WHERE id IS NOT NULL GROUP BY id),
    fine(id) AS (SELECT id FROM e WHERE p NOT IN (SELECT id FROM e) UNION ALL SELECT e.id FROM e JOIN fine ON e.p = fine.id),
    up(id, anc, distance) AS (SELECT id, id, 0::BIGINT FROM fine UNION ALL SELECT up.id, e.p, up.distance + 1 FROM up JOIN e ON e.id = up.anc WHERE e.p IN (SELECT id FROM e))"""

_SQL_P4 = """
    WITH a AS (
        SELECT id AS d, commit_seq AS s, coalesce(previous_id, 0) AS p, deleted AS x, FALSE AS gone, coll_name AS n, document AS t FROM doc_records
        UNION ALL SELECT new_doc_id, commit_seq, coalesce(old_doc_id, 0), deleted, new_doc_id = coalesce(old_doc_id, 0), coll_name, new_doc FROM index_updates WHERE new_doc_id <> 0),
    stand AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY d ORDER BY s DESC, n DESC, t DESC) = 1),
    kept AS (SELECT * FROM stand WHERE NOT gone),
    now AS (SELECT * FROM kept WHERE NOT x AND d NOT IN (SELECT p FROM kept))"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p2_found": p2_found, "p2_paths": p2_paths, "p2_ancestors": p2_ancestors, "p2_descendants": p2_descendants, "p2_descendant_counts": p2_descendant_counts, "p4_found": p4_found, "p4_documents": p4_documents, "p5_found": p5_found, "p5_valid": p5_valid}


def oracle_sql() -> dict[str, str]:
    names = ", ".join(f"c[{i + 1}] AS {name}" for i, name in enumerate(delimited.FIELDS))
    return {
        "p2_found": """
            WITH RECURSIVE e AS (SELECT id, max(CASE WHEN previous_id > 0 THEN previous_id ELSE -1 END) AS p FROM exported_docs WHERE id IS NOT NULL GROUP BY id),
            down(id, root_id, depth) AS (
                SELECT id, id, 0::BIGINT FROM e WHERE p NOT IN (SELECT id FROM e)
                UNION ALL SELECT e.id, down.root_id, down.depth + 1 FROM e JOIN down ON e.p = down.id),
            endless AS (SELECT id, p FROM e WHERE id NOT IN (SELECT id FROM down)),
            up(id, anc) AS (SELECT id, p FROM endless UNION SELECT up.id, endless.p FROM up JOIN endless ON endless.id = up.anc),
            loops AS (SELECT id FROM up WHERE id = anc)
            SELECT id, root_id, depth FROM down
            UNION ALL SELECT up.id, min(up.anc), -1 FROM up WHERE up.anc IN (SELECT id FROM loops) GROUP BY up.id""",
        "p2_paths": f"""{_SQL_P2},
            sizes AS (SELECT anc AS id, count(*) AS n FROM up GROUP BY 1),
            heirs AS (SELECT arg_min(e.id, (-s.n, e.id)) AS id, e.p FROM e JOIN sizes s USING (id) JOIN fine f ON f.id = e.p GROUP BY e.p),
            heads AS (SELECT id FROM fine WHERE id NOT IN (SELECT id FROM heirs)),
            line AS (SELECT up.id, arg_min(up.anc, up.distance) AS piece_id, min(up.distance) AS position FROM up JOIN heads ON heads.id = up.anc GROUP BY 1),
            roots AS (SELECT id, arg_max(anc, distance) AS root_id, max(distance) AS depth FROM up GROUP BY 1),
            ring(id, anc) AS (SELECT id, p FROM e WHERE id NOT IN (SELECT id FROM fine) UNION SELECT ring.id, e.p FROM ring JOIN e ON e.id = ring.anc)
            SELECT l.id, l.piece_id, l.position, h.piece_id AS from_piece, h.position AS from_position, r.root_id, r.depth
            FROM line l JOIN roots r USING (id) JOIN e ON e.id = l.piece_id LEFT JOIN line h ON h.id = e.p
            UNION ALL SELECT id, NULL, NULL, NULL, NULL, min(anc), -1 FROM ring WHERE anc IN (SELECT id FROM ring WHERE id = anc) GROUP BY id""",
        "p2_ancestors": f"{_SQL_P2} SELECT id, anc AS ancestor_id, distance FROM up WHERE id % 20 = 0",
        "p2_descendants": f"{_SQL_P2} SELECT anc AS id, id AS descendant_id, distance FROM up WHERE anc % 20 = 0 AND distance > 0",
        "p2_descendant_counts": f"{_SQL_P2} SELECT e.id, count(up.id) - 1 AS descendants FROM e LEFT JOIN up ON up.anc = e.id GROUP BY e.id",
        "p4_found": f"{_SQL_P4} SELECT d AS new_doc_id, s AS commit_seq FROM now",
        "p4_documents": f"{_SQL_P4} SELECT d AS doc_id, s AS seq, n AS coll_name, t AS document FROM now",
        "p5_found": _sql_p5("SELECT line_no, reason FROM r WHERE reason IS NOT NULL"),
        "p5_valid": _sql_p5(f"SELECT line_no, {names} FROM r WHERE reason IS NULL"),
    }
