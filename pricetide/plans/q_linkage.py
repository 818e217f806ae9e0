"""Re-listings, duplicates, clusters, similarity and text signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricetide import config as C
from pricetide.functions import text as T
from pricetide.operators import features as FE
from pricetide.operators import linkage as L
from pricetide.operators import similarity as S
from pricetide.plans import views as V
from pricetide.plans.registry import query
from pricetide.plans.views import snug, snug_col, with_views
from pricetide.session import cut_lineage

# wider than the defaults, because the tables' prices spread over two orders of magnitude
CFG = C.Thresholds(portals=("1", "2", "3", "4", "5"), cluster_price_tol=0.06, relist_price_tol=0.1)

_KIND_SQL = " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{n}'" for n, p in C.TITLE_TYPES.items())
_ALIASES = ", ".join(f"'{a}'" for a in C.PISO_ALIASES)
_STOP = ", ".join(f"'{w}'" for w in C.STREET_STOP_WORDS)
SIG_SQL = rf"""
  folded AS (SELECT *, trim(lower(strip_accents(title))) AS t FROM properties),
  sig AS (SELECT *, CASE {_KIND_SQL} END AS kind,
      list_filter(string_split_regex(regexp_extract(t, '\b(?:{C.STREET_WORDS})\b\s+(.+?)(?:,|$)', 1),
        '[^a-z0-9'']+'), lambda x: length(x) > 1 AND NOT regexp_matches(x, '^[0-9]+$') AND x NOT IN ({_STOP})) AS streets
    FROM folded WHERE price IS NOT NULL AND sqm IS NOT NULL)"""
_CONTRADICT = f"""(coalesce(a.kind <> b.kind AND NOT ((a.kind = 'piso' AND b.kind IN ({_ALIASES}))
  OR (b.kind = 'piso' AND a.kind IN ({_ALIASES}))), false)
  OR (len(a.streets) > 0 AND len(b.streets) > 0 AND NOT list_has_any(a.streets, b.streets)))"""
_EDIT = "(1 - levenshtein(a.t, b.t) / greatest(length(a.t), length(b.t)))"
RELIST_SQL = f"""{SIG_SQL},
  matches AS (SELECT a.population, a.property_id, b.property_id AS old_id, b.first_seen AS old_first FROM sig a
    JOIN sig b ON a.population = b.population AND a.status = 'active' AND b.status = 'inactive'
    WHERE floor(date_diff('second', b.last_seen, a.first_seen) / 86400.0) BETWEEN -1 AND 90
      AND coalesce(a.rooms = b.rooms, true) AND abs(a.sqm - b.sqm) <= 3
      AND abs(a.price - b.price) / greatest(b.price, 1) <= 0.1 AND NOT {_CONTRADICT} AND {_EDIT} >= 0.45),
  relist AS (SELECT population, property_id, arg_min(old_id, (old_first, old_id)) AS relisted_from,
    min(old_first) AS old_first FROM matches GROUP BY 1, 2)"""
EDGE_SQL = f"""{SIG_SQL},
  edges AS (SELECT a.population, a.property_id AS a_id, b.property_id AS b_id FROM sig a
    JOIN sig b ON a.population = b.population AND coalesce(a.rooms, -1) = coalesce(b.rooms, -1)
      AND a.property_id < b.property_id AND a.status = 'active' AND b.status = 'active'
    WHERE abs(a.sqm - b.sqm) <= 3 AND abs(a.price - b.price) / greatest(a.price, b.price) <= 0.06
      AND NOT {_CONTRADICT} AND (a.price = b.price OR {_EDIT} >= 0.45)),
  both_ways AS (SELECT population, a_id, b_id FROM edges UNION ALL SELECT population, b_id, a_id FROM edges),
  reach(population, node, seen) AS (SELECT population, property_id, property_id FROM sig WHERE status = 'active'
    UNION SELECT r.population, r.node, e.b_id FROM reach r
    JOIN both_ways e ON e.population = r.population AND e.a_id = r.seen),
  components AS (SELECT population, node AS property_id, min(seen) AS cluster_id FROM reach GROUP BY 1, 2),
  clustered AS (SELECT p.*, coalesce(c.cluster_id, p.property_id) AS cluster_id FROM properties p
    LEFT JOIN components c USING (population, property_id))"""


def _of_spells(sql: str) -> str:
    return sql.replace("FROM properties", "FROM spells")


# what hangs together at one price, as stars
_LEVEL_SQL = f"""level AS (SELECT a.population, a.property_id AS a, b.property_id AS b FROM reps a JOIN reps b
          ON a.population = b.population AND coalesce(a.rooms, -1) = coalesce(b.rooms, -1) AND a.price = b.price
          AND a.property_id <> b.property_id AND abs(a.sqm - b.sqm) <= 3 AND NOT {_CONTRADICT}),
        reach(population, node, seen) AS (SELECT population, property_id, property_id FROM reps
          UNION SELECT r.population, r.node, l.b FROM reach r JOIN level l ON l.population = r.population AND l.a = r.seen)"""
_STARS_SQL = """SELECT population, min(seen) AS a_id, node AS b_id, true AS same_price, NULL::DOUBLE AS similarity
        FROM reach GROUP BY population, node HAVING min(seen) <> node"""


@query(
    "relist_join",
    with_views(
        ["spells"],
        _of_spells(f"""{RELIST_SQL} SELECT population, property_id, relisted_from,
          least(first_seen, old_first) AS effective_first_seen, CAST(relisted_from IS NOT NULL AS INT) AS relist_count,
          round_even(date_diff('second', least(first_seen, coalesce(old_first, first_seen)),
            TIMESTAMP '{V.OBS_AS_OF}') / 86400.0 * 10, 0) / 10 AS days_online_effective
        FROM properties LEFT JOIN relist USING (population, property_id)"""),
    ),
)
def relist_join(spark, sf_dir):
    out = L.add_effective_age(cut_lineage(V.spells(spark, sf_dir)), V.OBS_AS_OF, CFG, similarity="edit")
    return out.select(*V.ENTITY, "relisted_from", "effective_first_seen", "relist_count", "days_online_effective")


@query(
    "duplicate_pairs",
    with_views(
        ["properties"],
        f"""{SIG_SQL},
        reps AS (SELECT population, rooms, sqm, price, t, any_value(kind) AS kind, any_value(streets) AS streets,
          min(property_id) AS property_id FROM sig WHERE status = 'active' GROUP BY 1, 2, 3, 4, 5),
        {_LEVEL_SQL}
        {_STARS_SQL}
        UNION ALL
        SELECT a.population, a.property_id, b.property_id, false, {snug(_EDIT, 6)}
        FROM reps a JOIN reps b ON a.population = b.population AND coalesce(a.rooms, -1) = coalesce(b.rooms, -1)
          AND a.property_id < b.property_id
        WHERE a.price <> b.price AND abs(a.sqm - b.sqm) <= 3 AND abs(a.price - b.price) / greatest(a.price, b.price) <= 0.06
          AND NOT {_CONTRADICT} AND {_EDIT} >= 0.45""",
    ),
)
def duplicate_pairs(spark, sf_dir):
    out = L.duplicate_pairs(V.properties(spark, sf_dir), CFG, similarity="edit")
    return out.withColumn("similarity", snug_col(F.col("similarity"), 6))


@query("clusters", with_views(["properties"], f"{EDGE_SQL} SELECT population, property_id, cluster_id FROM clustered"))
def clusters(spark, sf_dir):
    return L.cluster_ids(V.properties(spark, sf_dir), CFG, similarity="edit").select(*V.ENTITY, "cluster_id")


_CLUSTER_STATS = """
  stats AS (SELECT population, cluster_id, count(*) AS cluster_size, count(DISTINCT source) AS n_sources,
    count(DISTINCT CASE WHEN source NOT IN ('1', '2', '3', '4', '5') THEN source END) AS n_agency_sources,
    arg_min(property_id, (first_seen, property_id)) AS head FROM clustered GROUP BY 1, 2)"""


@query(
    "cluster_stats",
    with_views(
        ["properties"],
        EDGE_SQL
        + ","
        + _CLUSTER_STATS.replace("(first_seen, property_id)", "(-epoch_us(first_seen), property_id)")
        + """
        SELECT population, property_id, cluster_id, cluster_size, n_sources, n_agency_sources,
          CAST(n_agency_sources >= 2 OR n_sources >= 3 AS INT) AS multi_listed,
          CAST(property_id = head AS INT) AS is_cluster_canonical
        FROM clustered JOIN stats USING (population, cluster_id)""",
    ),
)
def cluster_stats(spark, sf_dir):
    out = L.cluster_listings(V.properties(spark, sf_dir), CFG, similarity="edit")
    return out.select(
        *V.ENTITY, "cluster_id", "cluster_size", "n_sources", "n_agency_sources", "multi_listed",
        "is_cluster_canonical",
    )


LIFE_CTES = _of_spells(
    EDGE_SQL
    + ","
    + RELIST_SQL.split("FROM folded WHERE price IS NOT NULL AND sqm IS NOT NULL),")[1]
    + """,
    links AS (SELECT population, cluster_id AS a, property_id AS b FROM clustered UNION ALL
      SELECT population, relisted_from, property_id FROM relist),
    two_way AS (SELECT population, a, b FROM links UNION ALL SELECT population, b, a FROM links),
    closure(population, node, seen) AS (SELECT population, property_id, property_id FROM properties
      UNION SELECT c.population, c.node, l.b FROM closure c
      JOIN two_way l ON l.population = c.population AND l.a = c.seen),
    lives AS (SELECT population, node AS property_id, min(seen) AS life_id FROM closure GROUP BY 1, 2)"""
)
_LIFE_SQL = with_views(["spells"], f"{LIFE_CTES} SELECT * FROM lives")


@query("market_life", _LIFE_SQL)
def market_life(spark, sf_dir):
    return life_frame(spark, sf_dir).select(*V.ENTITY, "life_id")


@query("market_life_grown", _LIFE_SQL)
def market_life_grown(spark, sf_dir):
    """The same units from a stored forest: clusters first, then only what the re-listings change of it."""
    aged = cut_lineage(L.add_effective_age(cut_lineage(V.spells(spark, sf_dir)), V.OBS_AS_OF, CFG, similarity="edit"))
    clustered = cut_lineage(L.cluster_ids(aged, CFG, similarity="edit"))
    forest = cut_lineage(
        clustered.where(F.col("cluster_id") != F.col("property_id"))
        .select("population", F.explode(F.array("cluster_id", "property_id")).alias("node"), F.col("cluster_id").alias("component"))
        .distinct()
    )
    again = clustered.where(F.col("relisted_from").isNotNull()).select("population", F.col("relisted_from").alias("a_id"), F.col("property_id").alias("b_id"))
    grown = L.grow_forest(forest, cut_lineage(L.grown_components(forest, again)))
    units = grown.select("population", F.col("node").alias("property_id"), "component")
    return clustered.join(units, V.ENTITY, "left").select(*V.ENTITY, F.coalesce("component", "property_id").alias("life_id"))


def life_frame(spark, sf_dir, spells=None):
    aged = L.add_effective_age(cut_lineage(V.spells(spark, sf_dir)) if spells is None else spells, V.OBS_AS_OF, CFG, similarity="edit")
    return L.market_life(L.cluster_ids(cut_lineage(aged), CFG, similarity="edit"))


# Matching blocks: runs of equal letters lie on diagonals; the longest one inside a stretch splits it in two.
_BLOCKS_SQL = f"""{SIG_SQL},
  reps AS (SELECT population, rooms, sqm, price, t, any_value(kind) AS kind, any_value(streets) AS streets,
    min(property_id) AS property_id FROM sig WHERE status = 'active' GROUP BY 1, 2, 3, 4, 5),
  cand AS (SELECT row_number() OVER () AS k, a.population, a.property_id AS a_id, b.property_id AS b_id, a.t AS ta, b.t AS tb
    FROM reps a JOIN reps b ON a.population = b.population AND coalesce(a.rooms, -1) = coalesce(b.rooms, -1)
      AND a.property_id < b.property_id
    WHERE a.price <> b.price AND abs(a.sqm - b.sqm) <= 3 AND abs(a.price - b.price) / greatest(a.price, b.price) <= 0.06
      AND NOT {_CONTRADICT}),
  hits AS (SELECT k, i, j FROM (SELECT k, ta, tb, unnest(range(1, length(ta) + 1)) AS i FROM cand) x,
      UNNEST(range(1, length(tb) + 1)) AS u(j) WHERE substr(ta, i, 1) = substr(tb, j, 1)),
  diagonals AS (SELECT k, i, i - j AS d, i - row_number() OVER (PARTITION BY k, i - j ORDER BY i) AS g FROM hits),
  runs AS (SELECT k, d, min(i) AS i0, max(i) + 1 AS i1 FROM diagonals GROUP BY k, d, g),
  stretch(k, la, ha, lb, hb) AS (SELECT k, 1::BIGINT, length(ta) + 1, 1::BIGINT, length(tb) + 1 FROM cand
    UNION ALL SELECT k, part.la, part.ha, part.lb, part.hb FROM (
      SELECT k, unnest([{{'la': la, 'ha': m.i, 'lb': lb, 'hb': m.j}},
                        {{'la': m.i + m.n, 'ha': ha, 'lb': m.j + m.n, 'hb': hb}}]) AS part FROM (
        SELECT s.k, la, ha, lb, hb, arg_min({{'i': i, 'j': i - d, 'n': e - i}}, (i - e, i, i - d)) AS m FROM (
          SELECT s.*, r.d, greatest(r.i0, s.la, s.lb + r.d) AS i, least(r.i1, s.ha, s.hb + r.d) AS e
          FROM stretch s JOIN runs r ON r.k = s.k) s WHERE e > i GROUP BY ALL))
    WHERE part.la < part.ha AND part.lb < part.hb),
  blocks AS (SELECT k, la, lb, max(e - i) AS n FROM (
      SELECT s.*, greatest(r.i0, s.la, s.lb + r.d) AS i, least(r.i1, s.ha, s.hb + r.d) AS e
      FROM stretch s JOIN runs r ON r.k = s.k) WHERE e > i GROUP BY k, la, ha, lb, hb),
  scores AS (SELECT k, 2.0 * sum(n) AS matched FROM blocks GROUP BY k),
  {_LEVEL_SQL}
  {_STARS_SQL}
  UNION ALL SELECT population, a_id, b_id, false, {snug('matched / (length(ta) + length(tb))', 6)} AS similarity
  FROM cand JOIN scores USING (k) WHERE matched / (length(ta) + length(tb)) >= 0.45"""


@query("duplicate_pairs_blocks", with_views(["properties"], _BLOCKS_SQL))
def duplicate_pairs_blocks(spark, sf_dir):
    """The same links judged by matching blocks, with the measured similarity."""
    out = L.duplicate_pairs(V.properties(spark, sf_dir), CFG, similarity="blocks")
    return out.withColumn("similarity", snug_col(F.col("similarity"), 6))


# ------------------------------------------------------------------ similarity

PROFILES = (
    C.IdealProfile(
        name="big", property_type="Casa", city="Brand#1", district="ring", target_price=40_000, target_rooms=4,
        target_bathrooms=2, target_sqm=120, required_location_terms=("carrer", "widget"),
        preferred_terms=("dúplex", "casa"), preferred_features={"has_pool": True, "has_ac": True},
        preferred_sources=("1", "2"),
    ),
    C.IdealProfile(
        name="small", property_type="estudio", city="Brand#2", target_price=25_000, price_tolerance_pct=0.2,
        target_rooms=2, target_bathrooms=1, target_sqm=60, preferred_terms=None,
        preferred_features={"has_ac": True},
    ),
)


def _num_sql(column: str, target: float | None, share: float, absolute: float) -> str:
    tol = float(max(round(target * share), absolute, 1))
    return f"CASE WHEN abs({column} - {target}) < {tol} THEN 1 - abs({column} - {target}) / {tol} ELSE 0 END"


def _found_sql(column: str, terms) -> str:
    import unicodedata

    plain = [unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode().lower() for t in terms]
    return "(" + " + ".join(f"CAST(contains({column}, '{t}') AS INT)" for t in plain) + f") / {float(len(plain))}"


_BIG = (
    f"(({_num_sql('price', 40_000, 0.25, 0)}) * 22 + ({_num_sql('rooms', 4, 0, 1)}) * 10"
    f" + ({_num_sql('bathrooms', 2, 0, 1)}) * 10 + ({_num_sql('sqm', 120, 0.25, 0)}) * 14"
    " + CAST(contains(lower(property_type), 'casa') AS INT) * 8"
    f" + ({_found_sql('place', ('carrer', 'widget', 'Brand#1', 'ring'))}) * 20"
    " + (has_pool + has_ac) / 2.0 * 8"
    f" + ({_found_sql('words', ('dúplex', 'casa'))}) * 5 + CAST(source IN ('1', '2') AS INT) * 3) / 100.0"
)
_SMALL = (
    f"(({_num_sql('price', 25_000, 0.2, 0)}) * 22 + ({_num_sql('rooms', 2, 0, 1)}) * 10"
    f" + ({_num_sql('bathrooms', 1, 0, 1)}) * 10 + ({_num_sql('sqm', 60, 0.25, 0)}) * 14"
    " + CAST(contains(lower(property_type), 'estudio') AS INT) * 8"
    f" + ({_found_sql('place', ('Brand#2',))}) * 20 + has_ac * 8) / 92.0"
)


SCORED_SQL = f"""words AS (SELECT *, lower(strip_accents(title || ' ' || url || ' ' || source)) AS words,
            lower(strip_accents(title || ' ' || url || ' ' || source || ' ' || neighborhood)) AS place
          FROM properties),
        scored AS (SELECT population, property_id, CAST(round_even({_BIG} * 100, 0) AS INT) AS big,
          CAST(round_even({_SMALL} * 100, 0) AS INT) AS small FROM words)"""


@query(
    "similarity",
    with_views(
        ["properties"],
        f"""{SCORED_SQL}
        SELECT population, property_id, greatest(big, small) AS similarity_score,
          CASE WHEN greatest(big, small) = 0 THEN NULL WHEN big >= small THEN 'big' ELSE 'small' END
            AS similarity_profile FROM scored""",
    ),
)
def similarity(spark, sf_dir):
    out = S.similarity(V.properties(spark, sf_dir), PROFILES)
    return out.select(*V.ENTITY, "similarity_score", "similarity_profile")


# ------------------------------------------------------------------ text

# fixed values: common fragments of the generated languages, standing for the keyword lists
SELLER = {"inheritance": r"\bthe\b|\bdes\b", "urgency": r"ation\b|urg", "renovation": r"mentre|tion in", "investor": r"ung\b"}
HOME = {"luminous": r"eaux|lich", "views": r"\b(de|la) que\b", "exterior": r"\bund\b", "quiet": r"heit|ente\b"}
_TEXT_SQL = r"""
  texts AS (SELECT doc_id, lang, 'Pis al Carrer ' || source || ', ' || lang AS title,
      text || ' orientación ' || (['sur', 'Norte', 'est', 'nordoest', 'arriba'])[CAST(doc_id % 5 + 1 AS INT)]
        || ', a ' || (doc_id % 47) || ' min de la estación, comunidad: ' || (doc_id % 9 + 1) || '.' || (100 + doc_id % 800)
        || ',50 €, ibi ' || (doc_id % 700) || ' €' AS description FROM documents),
  folded AS (SELECT *, trim(regexp_replace(regexp_replace(lower(strip_accents(title || ' ' || description)),
      '[^\x00-\x7F]', '', 'g'), '\s+', ' ', 'g')) AS t FROM texts)"""


def _texts(spark, sf_dir):
    doc = F.col("doc_id")
    words = F.array(*[F.lit(w) for w in ("sur", "Norte", "est", "nordoest", "arriba")])
    return V.table(spark, sf_dir, "documents").select(
        "doc_id",
        "lang",
        F.concat(F.lit("Pis al Carrer "), F.col("source"), F.lit(", "), F.col("lang")).alias("title"),
        F.concat(
            F.col("text"), F.lit(" orientación "), F.element_at(words, (doc % 5 + 1).cast("int")), F.lit(", a "),
            doc % 47, F.lit(" min de la estación, comunidad: "), doc % 9 + 1, F.lit("."), 100 + doc % 800,
            F.lit(",50 €, ibi "), doc % 700, F.lit(" €"),
        ).alias("description"),
    )


@query(
    "keyword_flags",
    "WITH "
    + _TEXT_SQL.strip()
    + " SELECT doc_id, "
    + ", ".join(f"CAST(regexp_matches(t, '{p}') AS INT) AS kw_{n}" for n, p in {**SELLER, **HOME}.items())
    + ", CAST("
    + " OR ".join(f"regexp_matches(t, '{p}')" for p in SELLER.values())
    + " AS INT) AS kw_any_motivated FROM folded",
)
def keyword_flags(spark, sf_dir):
    out = FE.text_signals(_texts(spark, sf_dir), SELLER, HOME)
    return out.select("doc_id", *[f"kw_{n}" for n in (*SELLER, *HOME)], "kw_any_motivated")


@query(
    "text_captures",
    "WITH "
    + _TEXT_SQL.strip()
    + r"""
  SELECT doc_id, CASE regexp_extract(t, 'orientacion (sur|norte|est|nordoest|arriba)', 1) WHEN 'sur' THEN 'sur'
      WHEN 'norte' THEN 'norte' WHEN 'est' THEN 'este' WHEN 'nordoest' THEN 'noroeste' END AS orientation,
    CAST(regexp_extract(t, '(\d{1,2})\s*min\w*.{0,20}?(estacion|fgc|tren|renfe)', 1) AS INT) AS walk_min_to_station,
    CAST(replace(replace(regexp_extract(description, '(?i)comunidad[:\s]*([\d][\d.,]*)\s*€', 1), '.', ''), ',', '.')
      AS DOUBLE) AS community_fee_eur_mo,
    CAST(regexp_extract(description, '(?i)\bibi[:\s]*([\d][\d.,]*)\s*€', 1) AS DOUBLE) AS ibi_eur_yr,
    trim(regexp_extract(title, '(?i)\b((?:carrer)\s+[^,]+)', 1)) AS street FROM folded""",
)
def text_captures(spark, sf_dir):
    out = FE.text_signals(_texts(spark, sf_dir), SELLER, HOME)
    return out.select("doc_id", "orientation", "walk_min_to_station", "community_fee_eur_mo", "ibi_eur_yr", "street")


@query(
    "text_fold",
    r"""SELECT doc_id, trim(regexp_replace(regexp_replace(lower(strip_accents(text)), '[^\x00-\x7F]', '', 'g'),
      '\s+', ' ', 'g')) AS folded FROM documents""",
)
def text_fold(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.fold(F.col("text")).alias("folded"))
