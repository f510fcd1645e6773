"""The shipped grammars: what they take as a whole and what they don't."""

import pytest

from spanweave.grammar import library
from spanweave.kernel.matcher import Matcher

SQL = """
SELECT 1
select a, b.c as d, "q x", count(*) n from t as x, u where a = 1 and not b is null;
SELECT DISTINCT * FROM a LEFT OUTER JOIN b ON a.x = b.y NATURAL JOIN c INNER JOIN d USING (k, l) CROSS JOIN e
SELECT x FROM (SELECT y FROM z) AS s GROUP BY x, y HAVING sum(x) > 3 ORDER BY x DESC NULLS LAST, 2 LIMIT 10 OFFSET 5
WITH RECURSIVE c(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM c WHERE n < 10), d AS NOT MATERIALIZED (VALUES (1, 'a''b')) SELECT * FROM c UNION SELECT * FROM d EXCEPT SELECT 1 INTERSECT SELECT 2
SELECT sum(x) FILTER (WHERE x > 0) OVER (PARTITION BY a ORDER BY b ROWS BETWEEN 1 PRECEDING AND CURRENT ROW EXCLUDE TIES) FROM t WINDOW w AS (ORDER BY c RANGE UNBOUNDED PRECEDING)
SELECT row_number() OVER w, lag(x, 1, 0) OVER (w GROUPS BETWEEN UNBOUNDED PRECEDING AND 2 FOLLOWING) FROM t
INSERT INTO t (a, b) VALUES (1, ?), (:x, @y) ON CONFLICT (a) WHERE b > 0 DO UPDATE SET b = excluded.b, (c, d) = (1, 2) WHERE c IS NOT NULL RETURNING *
INSERT OR REPLACE INTO t DEFAULT VALUES
REPLACE INTO t SELECT replace(a, 'x', 'y') FROM u
UPDATE t SET a = a + 1, b = NULL FROM u WHERE t.id = u.id RETURNING a AS x
DELETE FROM main.t WHERE a IN (1, 2, 3) OR b NOT IN (SELECT c FROM d) OR e BETWEEN 1 AND 2 AND f LIKE '%x' ESCAPE '!'
CREATE TABLE IF NOT EXISTS t (id INTEGER PRIMARY KEY AUTOINCREMENT, v VARCHAR(10) NOT NULL DEFAULT 'x' COLLATE nocase, w DECIMAL(10, 2) CHECK (w > 0), f REFERENCES u(id) ON DELETE CASCADE, g AS (id * 2) STORED, CONSTRAINT k UNIQUE (v, w), FOREIGN KEY (f) REFERENCES u) WITHOUT ROWID, STRICT
CREATE TEMP TABLE x AS SELECT 1
CREATE UNIQUE INDEX i ON t (a, b DESC) WHERE a > 0; CREATE VIEW v (a) AS SELECT 1; DROP TABLE IF EXISTS t
CREATE TRIGGER g AFTER UPDATE OF a, b ON t FOR EACH ROW WHEN new.a > old.a BEGIN UPDATE u SET x = 1; SELECT raise(ABORT, 'no'); END
ALTER TABLE t RENAME TO u; ALTER TABLE t RENAME COLUMN a TO b; ALTER TABLE t ADD COLUMN c INT; ALTER TABLE t DROP COLUMN d
BEGIN IMMEDIATE TRANSACTION; SAVEPOINT s; ROLLBACK TO SAVEPOINT s; RELEASE s; COMMIT; END
PRAGMA main.cache_size = -2000; PRAGMA table_info(t); VACUUM; ANALYZE t; REINDEX; ATTACH 'f.db' AS f; DETACH f
EXPLAIN QUERY PLAN SELECT CASE x WHEN 1 THEN 'a' ELSE 'b' END, CASE WHEN a THEN b END, CAST(x AS NUMERIC(3, 1)), EXISTS (SELECT 1), NOT EXISTS (SELECT 2) FROM t
SELECT -1.5e-3 + .5 * 0xFF / 2 % 3 || 'x' -> '$.a' ->> 'b', ~x & 1 | 2 << 3 >> 4, x'0AfF', current_timestamp, NULL, TRUE -- the end
SELECT /* a comment */ `a`, [b c], a <> 1, a != 2, a == 3, a >= 4, a IS DISTINCT FROM b, c ISNULL, d NOT NULL, (1, 2) = (3, 4)
;;
""".strip().split("\n")
NOT_SQL = """
SELEC 1
SELECT FROM t
SELECT a b c FROM t
SELECT * FROM t WHERE
SELECT 1 +
INSERT t VALUES (1)
UPDATE t a = 1
CREATE TABLE t ()
SELECT 'open
SELECT (1
SELECT select FROM t
SELECT 12ab
SELECT 1 SELECT 2
""".strip().split("\n")
TOML = ["a = 1", '[a.b."c d"]\nx = "s\\n\\u00e9"\n\n[[list]] # c\ny = [1, 2.5e3,\n  # c\n  "x",\n]\nz = { a = true, b.c = 1979-05-27T07:32:00Z }', "m = '''\na'b\n'''\nq = 0xdead_beef\n", "t = 07:32:00\ni = -inf", ""]
NOT_TOML = ["a =", "a = 1 b = 2", "[a", 'x = "open', "= 1", "a = 1__0", "x = 'a\nb'"]
CSS = ["a, b > c .d#e:hover::before { color: #fff; margin: 0 auto -1.5em !important } /* x */", '@media screen and (min-width: 100px) { p { background: url("x.png") no-repeat, rgba(0, 0, 0, 50%); } }', '@import "x.css";', ".a { --x: 1px; width: calc(1px + var(--x) * 2); &:hover { top: 0 } }", "[type=text] + *::after{content:'\\201C'}", ""]
NOT_CSS = ["a { color }", "a { color: red", "{ x: y }", "a color: red }", "@media"]
KINDS = set("keyword string number comment operator punctuation type function constant property variable".split())


@pytest.mark.parametrize(("grammar", "text", "whole"), [(g, t, w) for g, good, bad in (("sql", SQL, NOT_SQL), ("toml", TOML, NOT_TOML), ("css", CSS, NOT_CSS)) for ts, w in ((good, True), (bad, False)) for t in ts])
def test_whole_documents(grammar, text, whole):
    found = Matcher(library.program(grammar)).match(text.encode())
    assert found.complete == whole, text[found.matched :]
    assert {k for k, _, _ in found.captures} <= KINDS
    assert found.captures or not whole or not text


def test_keywords_and_names_are_told_apart():
    text = b"SELECT selected, key FROM orders ORDER BY ordering"
    found = Matcher(library.program("sql")).match(text)
    words = [(k, text[a:b].decode()) for k, a, b in found.captures if k in ("keyword", "variable")]
    assert [w for k, w in words if k == "keyword"] == ["SELECT", "FROM", "ORDER", "BY"]
    assert [w for k, w in words if k == "variable"] == ["selected", "key", "orders", "ordering"]
