"""Registry of queries with their SQL statement of the same result.

SQL texts may use ``R6(expr)`` for rounding without negative zero and ``@name``
for the shared table expressions below.
"""

from __future__ import annotations

import re
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}

VIEWS = {
    "pts": """pts AS (SELECT vec_id AS id, label, s::INT AS seq,
  (1 + embedding[s]::DOUBLE) * cos(2*pi()*(s-1)/64) AS x,
  (1 + embedding[s]::DOUBLE) * sin(2*pi()*(s-1)/64) AS y
  FROM embeddings, range(1, 65) t(s))""",
    "scores": """scores AS (SELECT vec_id AS "ID", embedding[1]::DOUBLE AS "PC1",
  embedding[2]::DOUBLE AS "PC2", embedding[3]::DOUBLE AS "PC3", embedding[4]::DOUBLE AS "PC4",
  embedding[5]::DOUBLE AS "PC5", embedding[6]::DOUBLE AS "PC6", embedding[7]::DOUBLE AS "PC7",
  embedding[8]::DOUBLE AS "PC8", label AS "group" FROM embeddings)""",
    "long": """long AS (SELECT vec_id AS id, label, s::INT AS pc, embedding[s]::DOUBLE AS score
  FROM embeddings, range(1, 9) t(s))""",
    "cloud": """cloud AS (SELECT l_orderkey*10 + l_linenumber AS id, l_quantity AS x,
  l_extendedprice AS y, l_returnflag AS g FROM lineitem)""",
    "dirty": """dirty AS (SELECT vec_id AS "ID", CASE WHEN vec_id % 11 = 0 THEN NULL
  WHEN vec_id % 13 = 0 THEN 'nan'::DOUBLE WHEN vec_id % 17 = 0 THEN 'inf'::DOUBLE
  ELSE embedding[1]::DOUBLE END AS x, embedding[2]::DOUBLE AS y, label AS g FROM embeddings)""",
    # centroid, centred coordinates and moments of the outlines
    "cen": """cen AS (SELECT id, avg(x) AS mx, avg(y) AS my, count(*) AS n FROM pts GROUP BY id)""",
    "ctr": """ctr AS (SELECT p.id, p.label, p.seq, p.x - c.mx AS x, p.y - c.my AS y, c.n, c.mx, c.my
  FROM pts p JOIN cen c USING (id))""",
    "mom": """mom AS (SELECT id, sum(x*x)/(count(*)-1) AS sxx, sum(x*y)/(count(*)-1) AS sxy,
  sum(y*y)/(count(*)-1) AS syy FROM ctr GROUP BY id)""",
    "axes": """axes AS (SELECT id, c*fu AS ux, s*fu AS uy, -s*fv AS vx, c*fv AS vy, l1, l2 FROM (
  SELECT *, CASE WHEN abs(c) >= abs(s) THEN 1 ELSE sign(s) END AS fu,
  CASE WHEN abs(s) >= abs(c) THEN sign(-s) ELSE 1 END AS fv FROM (
  SELECT id, cos(0.5*atan2(2*sxy, sxx-syy)) AS c, sin(0.5*atan2(2*sxy, sxx-syy)) AS s,
  (sxx+syy)/2 + sqrt(((sxx-syy)/2)**2 + sxy**2) AS l1,
  (sxx+syy)/2 - sqrt(((sxx-syy)/2)**2 + sxy**2) AS l2 FROM mom)))""",
    "stp": """stp AS (SELECT id, seq, x, y, lx, ly, sqrt((x-lx)**2 + (y-ly)**2) AS d FROM (
  SELECT *, lag(x) OVER w AS lx, lag(y) OVER w AS ly FROM pts WINDOW w AS (PARTITION BY id ORDER BY seq)))""",
    # forward elliptic Fourier coefficients of the 64-point outlines, 12 harmonics
    "wrap": """wrap AS (SELECT p.id, p.label, p.seq, p.x, p.y, q.x AS px, q.y AS py,
  greatest(sqrt((p.x-q.x)**2 + (p.y-q.y)**2), 1e-10) AS t FROM pts p JOIN pts q
  ON p.id = q.id AND q.seq = CASE WHEN p.seq = 1 THEN 64 ELSE p.seq - 1 END)""",
    "cum": """cum AS (SELECT *, sum(t) OVER (PARTITION BY id ORDER BY seq) AS t1,
  sum(t) OVER (PARTITION BY id) AS tt FROM wrap)""",
    "ef": """ef AS (SELECT id, label, h, max(tt)/(2*pi()**2*h*h) * sum((x-px)/t*(cos(2*pi()*h*t1/tt) - cos(2*pi()*h*(t1-t)/tt))) AS a,
  max(tt)/(2*pi()**2*h*h) * sum((x-px)/t*(sin(2*pi()*h*t1/tt) - sin(2*pi()*h*(t1-t)/tt))) AS b,
  max(tt)/(2*pi()**2*h*h) * sum((y-py)/t*(cos(2*pi()*h*t1/tt) - cos(2*pi()*h*(t1-t)/tt))) AS c,
  max(tt)/(2*pi()**2*h*h) * sum((y-py)/t*(sin(2*pi()*h*t1/tt) - sin(2*pi()*h*(t1-t)/tt))) AS d
  FROM cum, (SELECT r::INT AS h FROM range(1, 13) t(r)) GROUP BY id, label, h)""",
    "ef0": """ef0 AS (SELECT id, 2*sum(x*t/tt) AS ao, 2*sum(y*t/tt) AS co FROM cum GROUP BY id)""",
    # first-ellipse normalisation: th (phase), psi (rotation), size
    "nrm": """nrm AS (SELECT id, th, sqrt(aa*aa + cc*cc) AS size,
  atan(cc/aa) - floor(atan(cc/aa)/pi())*pi() + CASE WHEN aa < 0 THEN pi() ELSE 0 END AS psi FROM (
  SELECT id, th, a*cos(th) + b*sin(th) AS aa, c*cos(th) + d*sin(th) AS cc FROM (
  SELECT *, t2 + pi()/2 - floor((t2 + pi()/2)/pi())*pi() - pi()/2 AS th FROM (
  SELECT *, t0 + CASE WHEN (a*cos(t0)+b*sin(t0))**2 + (c*cos(t0)+d*sin(t0))**2
    < (b*cos(t0)-a*sin(t0))**2 + (d*cos(t0)-c*sin(t0))**2 THEN pi()/2 ELSE 0 END AS t2 FROM (
  SELECT *, 0.5*(q - floor(q/pi())*pi()) AS t0 FROM (
  SELECT *, atan(2*(a*b + c*d)/(a*a + c*c - b*b - d*d)) AS q FROM ef WHERE h = 1))))))""",
    "efn": """efn AS (SELECT id, label, h, (cp*a1 + sp*c1)/size AS a, (cp*b1 + sp*d1)/size AS b,
  (cp*c1 - sp*a1)/size AS c, (cp*d1 - sp*b1)/size AS d FROM (
  SELECT e.id, label, h, size, cos(psi) AS cp, sin(psi) AS sp,
  a*cos(h*th) + b*sin(h*th) AS a1, b*cos(h*th) - a*sin(h*th) AS b1,
  c*cos(h*th) + d*sin(h*th) AS c1, d*cos(h*th) - c*sin(h*th) AS d1
  FROM ef e JOIN nrm n USING (id)))""",
    # coefficients of the set: normalised, first one positive, tiny values 0
    "coe": """coe AS (SELECT id, label, letter, h, CASE WHEN abs(v) < 1e-12 THEN 0 ELSE v END AS value FROM (
  SELECT id, label, h, unnest(['A','B','C','D']) AS letter,
  unnest([a*sg, b*sg, c*sg, d*sg]) AS v FROM (
  SELECT e.*, CASE WHEN f.a < 0 THEN -1 ELSE 1 END AS sg FROM efn e JOIN efn f
  ON e.id = f.id AND f.h = 1)))""",
    # six harmonics as 24 numbered coefficients; cosine axes; model projections
    "cf": """cf AS (SELECT id, label, (strpos('ABCD', letter) - 1)*6 + h AS pos, value FROM coe WHERE h <= 6)""",
    "rot": """rot AS (SELECT i AS pos, k AS pc, sqrt(2/24.0)*cos(pi()*(i - 0.5)*k/24) AS loading
  FROM range(1, 25) a(i), range(1, 6) b(k))""",
    "mn": """mn AS (SELECT pos, avg(value) AS m FROM cf GROUP BY pos)""",
    "sc": """sc AS (SELECT id, label, pc::INT AS pc, sum((value - m)*loading) AS score FROM cf JOIN mn USING (pos)
  JOIN rot USING (pos) GROUP BY id, label, pc)""",
    "sdv": """sdv AS (SELECT pc, stddev_samp(score) AS sdev FROM sc GROUP BY pc)""",
    # binary 32 x 32 images
    "pix": """pix AS (SELECT vec_id AS img, (k//32)::INT AS "row", (k%32)::INT AS col,
  CASE WHEN sqrt((k%32 - 16)**2 + (k//32 - 16)**2) <= 10*(1 + embedding[
    ((floor((a - floor(a/(2*pi()))*2*pi())/(2*pi())*64 + 0.5)::INT) % 64) + 1]::DOUBLE) THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS v
  FROM embeddings, (SELECT k, atan2(k//32 - 16, k%32 - 16) AS a FROM range(0, 1024) t(k)))""",
}

REQUIRES = {
    "cen": ["pts"], "ctr": ["pts", "cen"], "mom": ["pts", "cen", "ctr"],
    "axes": ["pts", "cen", "ctr", "mom"], "stp": ["pts"], "wrap": ["pts"], "cum": ["pts", "wrap"],
    "ef": ["pts", "wrap", "cum"], "ef0": ["pts", "wrap", "cum"],
    "nrm": ["pts", "wrap", "cum", "ef"], "efn": ["pts", "wrap", "cum", "ef", "nrm"],
    "coe": ["pts", "wrap", "cum", "ef", "nrm", "efn"],
    "cf": ["pts", "wrap", "cum", "ef", "nrm", "efn", "coe"],
}
REQUIRES["mn"] = [*REQUIRES["cf"], "cf"]
REQUIRES["sc"] = [*REQUIRES["mn"], "mn", "rot"]
REQUIRES["sdv"] = [*REQUIRES["sc"], "sc"]


def _rounding(sql: str) -> str:
    while True:
        at = sql.find("R6(")
        if at < 0:
            return sql
        depth, i = 1, at + 3
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            i += 1
        sql = f"{sql[:at]}(round(({sql[at + 3:i - 1]}), 6) + 0.0){sql[i:]}"


def expand(sql: str) -> str:
    """Fill in the shared table expressions and the rounding."""
    seen: list[str] = []

    def sub(m):
        out = []
        for name in [*REQUIRES.get(m.group(1), []), m.group(1)]:
            if name not in seen:
                seen.append(name)
                out.append(VIEWS[name])
        return ",\n".join(out) if out else ""
    text = re.sub(r"@(\w+)", sub, sql)
    text = re.sub(r",\s*(?=,)", "", text)
    return _rounding(text)


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""
    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = expand(sql)
        return fn
    return wrap
