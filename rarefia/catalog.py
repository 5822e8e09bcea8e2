"""Registered queries of the library, each with the SQL that gives the same rows in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import operators as ops
from .functions import absent_by_size
from .plans import Diversity, views

G = 8
#: Missing fractions above this delete a locus in the filtered queries.
TOLERANCE = 0.1

HEAD = """
with calls as ({calls}),
 ps as (select pop, dense_rank() over (order by pop) - 1 as pi from (select distinct pop from calls)),
 n as (select locus, pop, allele, count(*) as n from calls where allele is not null group by all),
 l as (select distinct locus from calls),
 nj as (select l.locus, ps.pop, ps.pi, count(c.allele) as nj from l cross join ps left join calls c on c.locus = l.locus and c.pop = ps.pop group by all),
 a as (select distinct locus, allele from n),
 d as (select nj.locus, nj.pop, nj.pi, a.allele, nj.nj, coalesce(n.n, 0) as n from nj join a on a.locus = nj.locus
       left join n on n.locus = nj.locus and n.pop = nj.pop and n.allele = a.allele),
 g as (select unnest(range(2, {g} + 1)) as g),
 q as (select d.*, g.g, list_product(list_transform(range(0, g.g), lambda u: greatest(nj - n - u, 0)::double / (nj - u))) as q from d join g on g.g <= d.nj),
 ok as (select pop, min(nj) as m from nj group by pop),
 rl as (select q.pop, q.g, locus, sum(1 - q) as v from q join ok on ok.pop = q.pop and q.g <= ok.m group by all),
 c as (select mask, bit_count(mask) as k, (select string_agg(pop, ' ' order by pi) from ps where (mask >> pi) & 1 = 1) as combo
       from (select unnest(range(1, (1 << (select count(*) from ps where {small}))::bigint)) as mask)),
 t as (select c.combo, c.k, q.g, q.locus, q.allele, product(case when (c.mask >> q.pi) & 1 = 1 then 1 - q.q else q.q end) as x
       from q cross join c where q.g <= (select min(nj) from nj) and {ks} group by all),
 cl as (select combo, k, g, locus, sum(x) as v from t group by all)
"""
STATS = "count(*)::bigint as num_loci, round(avg(v), 6) as mean, round(var_samp(v), 6) as var, round(sqrt(var_samp(v) / count(*)), 6) as std_err"


def head(calls: str, g: int = G, ks: str = "true") -> str:
    """``ks`` limits the combinations; where none are read, their table isn't built either."""
    return HEAD.format(calls=calls, g=g, ks=ks, small="true" if ks != "none" else "false").replace("and none", "and false")


def rounded(df: DataFrame) -> DataFrame:
    """Six places, as sums of doubles differ in their order."""
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def named(df: DataFrame) -> DataFrame:
    """Combinations by name."""
    return df.withColumn("combo", F.array_join("combo", " "))


def diversity(view, **options):
    return lambda spark, sf_dir: Diversity(view(spark, sf_dir), options.get("max_g", G), options.get("tolerance", 1.0))


def _every_k(d: Diversity) -> DataFrame:
    return rounded(named(d.every_combination(range(1, len(d.pops) + 1))))


def _identity(d: Diversity) -> DataFrame:
    """A population's richness against the sum of the private richness of all combinations that hold it."""
    parts = d.every_combination(range(1, len(d.pops) + 1), zeros=False).select(F.explode("combo").alias("pop"), "g", "mean")
    total = parts.groupBy("pop", "g").agg(F.sum("mean").alias("total"))
    both = d.richness().select("pop", "g", "mean").join(total, ["pop", "g"])
    return both.select("pop", "g", (F.abs(F.col("mean") - F.col("total")) < 1e-6).alias("equal"))


def _over_populations(d: Diversity) -> DataFrame:
    return rounded(ops.summary(d.richness_by_locus(), ["locus"], len(d.pops)))


def _q_rows(calls: DataFrame) -> DataFrame:
    """q of every allele, population and size, with 0 counts."""
    sizes = ops.sample_sizes(calls)
    pops = [r["pop"] for r in calls.select("pop").distinct().orderBy("pop").collect()]
    both = ops.dense_counts(calls, pops).join(sizes, ["locus", "pop"])
    q = both.withColumn("q", absent_by_size(F.col("n"), F.col("nj"), G))
    sized = ops.by_g(q, F.least(F.col("nj"), F.lit(G)))
    return sized.select("locus", "allele", "pop", "g", F.round(F.get("q", F.col("g")), 6).alias("q"))


def _grid(spark, pops: list[str]) -> DataFrame:
    return named(ops.combination_grid(spark, pops, 2, G).withColumn("combo", ops.named("combo", pops)))


def _wide(spark, sf_dir: str) -> DataFrame:
    d = diversity(views.part)(spark, sf_dir)
    loci = ["p_brand", "p_size", "p_word"]
    return rounded(ops.full_wide(d.richness_by_locus(), ["pop"], loci, d.richness()))


def queries() -> dict:
    part, line, event, supp, miss = (diversity(v) for v in (views.part, views.line, views.event, views.supp, views.miss))
    kept = diversity(views.miss, tolerance=TOLERANCE)
    calls = views.part
    return {
        "richness": lambda s, d: rounded(part(s, d).richness()),
        "unpivot_calls": lambda s, d: calls(s, d).groupBy("pop", "locus", "allele").count(),
        "pop_call_counts": lambda s, d: ops.populations(views.miss(s, d)).select("pop", "calls", F.col("idx").cast("long").alias("idx")),
        "distinct_alleles": lambda s, d: ops.distinct_alleles(views.miss(s, d)),
        "missingness": lambda s, d: rounded(ops.missingness(views.miss(s, d))),
        "bad_loci": lambda s, d: kept(s, d).deleted_loci(),
        "loci_at_tolerance": lambda s, d: diversity(views.equal, tolerance=0.3)(s, d).calls.groupBy("locus", "pop").agg(F.count("allele").alias("present"), F.count_if(F.col("allele").isNull()).alias("missing")),
        "calls_filtered": lambda s, d: kept(s, d).calls.groupBy("pop", "locus").agg(F.count("*").alias("calls"), F.count("allele").alias("present")),
        "allele_counts": lambda s, d: ops.allele_counts(views.miss(s, d)),
        "allele_counts_dense": lambda s, d: ops.dense_counts(calls(s, d), part(s, d).pops),
        "sample_sizes": lambda s, d: ops.sample_sizes(views.miss(s, d)),
        "min_sample_size": lambda s, d: ops.least_sizes(ops.sample_sizes(views.supp(s, d)), supp(s, d).loci),
        "q_table": lambda s, d: _q_rows(calls(s, d)),
        "richness_locus": lambda s, d: rounded(part(s, d).richness_by_locus()),
        "richness_line": lambda s, d: rounded(line(s, d).richness()),
        "richness_event": lambda s, d: rounded(event(s, d).richness()),
        "richness_supp": lambda s, d: rounded(supp(s, d).richness()),
        "richness_filtered": lambda s, d: rounded(kept(s, d).richness()),
        "richness_full_wide": _wide,
        "private_locus": lambda s, d: rounded(part(s, d).private_by_locus()),
        "private": lambda s, d: rounded(part(s, d).private()),
        "private_line": lambda s, d: rounded(line(s, d).private()),
        "private_supp": lambda s, d: rounded(supp(s, d).private()),
        "private_filtered": lambda s, d: rounded(kept(s, d).private()),
        "pop_combinations": lambda s, d: _grid(s, part(s, d).pops),
        "comb2_locus": lambda s, d: rounded(named(part(s, d).combinations_by_locus(2))),
        "comb2": lambda s, d: rounded(named(part(s, d).combinations(2))),
        "comb3_line": lambda s, d: rounded(named(line(s, d).combinations(3))),
        "comb_all_k": lambda s, d: _every_k(part(s, d)),
        # over the populations of each locus, so that other values meet than in richness
        "stats_mean_var_se": lambda s, d: _over_populations(event(s, d)),
        "subset_sum_identity": lambda s, d: _identity(part(s, d)),
    }


def oracles() -> dict:
    part, line, event, supp, miss = views.PART_SQL, views.LINE_SQL, views.EVENT_SQL, views.SUPP_SQL, views.MISS_SQL
    bad = f"select locus from (select locus, pop, avg((allele is null)::int) as f from ({miss}) group by all) group by locus having max(f) > {TOLERANCE}"
    kept = f"select * from ({miss}) where locus not in ({bad})"
    richness = f"select pop, g, {STATS} from rl group by pop, g"
    private = f"select combo as pop, g, {STATS} from cl group by all"
    combos = f"select combo, g, {STATS} from cl group by combo, g"
    # where only single populations are read, their masks alone are built: 25 populations would make 2^25
    single = HEAD.replace("(select unnest(range(1, (1 << (select count(*) from ps where {small}))::bigint)) as mask)", "(select 1::bigint << pi as mask from ps)")
    one = lambda calls: single.format(calls=calls, g=G, ks="true") + private
    rich = lambda calls: head(calls, ks="none") + richness
    return {
        "richness": rich(part),
        "unpivot_calls": f"select pop, locus, allele, count(*) as count from ({part}) group by all",
        "pop_call_counts": f"select pop, count(*) as calls, dense_rank() over (order by pop) - 1 as idx from ({miss}) group by pop",
        "distinct_alleles": f"select locus, count(distinct allele) as alleles from ({miss}) group by locus",
        "missingness": f"select locus, pop, round(avg((allele is null)::int), 6) as missing_fraction from ({miss}) group by all",
        "bad_loci": bad,
        # whole numbers, so that 3 of 10 isn't above 0.3
        "loci_at_tolerance": f"""with c as ({views.EQUAL_SQL}), f as (select locus, pop, count(allele) as present, count(*) - count(allele) as missing from c group by all)
          select locus, pop, present, missing from f where locus not in (select locus from f where 10 * missing > 3 * (present + missing))""",
        "calls_filtered": f"select pop, locus, count(*) as calls, count(allele) as present from ({kept}) group by all",
        "allele_counts": f"select locus, allele, pop, count(*) as n from ({miss}) where allele is not null group by all",
        "allele_counts_dense": head(part, ks="none") + "select locus, allele, pop, n from d",
        "sample_sizes": f"select locus, pop, count(allele) as nj from ({miss}) group by all",
        "min_sample_size": head(supp, ks="none") + "select pop, m as least from ok",
        "q_table": head(part, ks="none") + "select locus, allele, pop, g::int as g, round(q, 6) as q from q",
        "richness_locus": head(part, ks="none") + "select pop, g, locus, round(v, 6) as value from rl",
        "richness_line": rich(line),
        "richness_event": rich(event),
        "richness_supp": rich(supp),
        "richness_filtered": rich(kept),
        "richness_full_wide": head(part, ks="none") + """select pop, g, round(max(v) filter (locus = 'p_brand'), 6) as p_brand, round(max(v) filter (locus = 'p_size'), 6) as p_size,
          round(max(v) filter (locus = 'p_word'), 6) as p_word, """ + STATS + " from rl group by pop, g",
        "private_locus": single.format(calls=part, g=G, ks="true") + "select combo as pop, g, locus, round(v, 6) as value from cl",
        "private": one(part),
        "private_line": one(line),
        "private_supp": one(supp),
        "private_filtered": one(kept),
        "pop_combinations": head(part) + f"select combo, g from c, (select unnest(range(2, {G} + 1)) as g) where k = 2",
        "comb2_locus": head(part, ks="c.k = 2") + "select combo, g, locus, round(v, 6) as value from cl",
        "comb2": head(part, ks="c.k = 2") + combos,
        "comb3_line": head(line, ks="c.k = 3") + combos,
        "comb_all_k": head(part) + f"select combo, k::bigint as k, g, {STATS} from cl group by combo, k, g",
        "stats_mean_var_se": head(event, ks="none") + f"select locus, g, {STATS} from rl group by locus, g",
        "subset_sum_identity": head(part) + """select r.pop, r.g, abs(r.m - s.m) < 1e-6 as equal from (select pop, g, avg(v) as m from rl group by all) r
          join (select pop, g, sum(m) as m from (select ps.pop, x.g, x.m from (select c.mask, cl.g, avg(v) as m from cl join c on c.combo = cl.combo group by all) x join ps on (x.mask >> ps.pi) & 1 = 1) group by all) s
          on r.pop = s.pop and r.g = s.g""",
    }
