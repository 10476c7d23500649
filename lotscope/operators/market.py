"""Market report: cost per unit by year, supply, price bands, sellers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotscope.functions.numbers import price_band
from lotscope.operators.records import derive_listing
from lotscope.plans import order_stats as st
from lotscope.plans.lineage import cut_lineage
from lotscope.plans.ranked import top_n


def supply_by_year(records: DataFrame) -> DataFrame:
    """Listings whose composition touches each year, priced or not."""
    return _supply(derive_listing(records))


def _supply(derived: DataFrame) -> DataFrame:
    years = derived.select(F.explode(F.map_keys("year_counts")).alias("year"))
    return years.groupBy("year").agg(F.count(F.lit(1)).alias("supply"))


def comps(records: DataFrame) -> DataFrame:
    """Priced single-year listings with their asking price per unit."""
    return _comps(derive_listing(records))


def _comps(derived: DataFrame) -> DataFrame:
    d = derived.where((F.col("asking") > 0) & F.col("single_year").isNotNull() & (F.col("single_year") != ""))
    return d.select(F.col("single_year").alias("year"), (F.col("asking") / F.col("unit_count")).alias("cost"), "unit_count")


def cost_per_unit(records: DataFrame, min_comps: int = 1) -> DataFrame:
    """Per year: n, median, min, max, quartiles (from four comps on), whole-number median lot, supply.

    Cost and lot size are ranked in one pass as two measures of the same year.
    """
    n = F.col("n")
    both = F.explode(F.array(F.struct(F.lit("cost").alias("m"), F.col("cost").alias("v")),
                             F.struct(F.lit("lot").alias("m"), F.col("unit_count").cast("double").alias("v"))))
    derived = cut_lineage(derive_listing(records))  # read by the price ranks, twice, and by the supply count
    sample = _comps(derived).select("year", both.alias("_s")).select("year", F.col("_s.m").alias("m"), F.col("_s.v").alias("v"))
    ranks = {**st.median_ranks("median"), **st.exclusive_quartile_ranks("p25", 1), **st.exclusive_quartile_ranks("p75", 3),
             "min": F.lit(1), "max": n}
    stats = st.order_stats(sample, ["year", "m"], F.col("v"), ranks).where(n >= min_comps)
    quartile = lambda name, i: F.when(n >= 4, st.exclusive_quartile(name, i))
    values = {"median": st.median_of("median"), "min": F.col("min"), "max": F.col("max"),
              "p25": quartile("p25", 1), "p75": quartile("p75", 3)}
    of = lambda m, c: F.max(F.when(F.col("m") == m, c))
    table = stats.groupBy("year").agg(F.max("n").alias("n"), *[of("cost", c).alias(k) for k, c in values.items()],
                                      F.floor(of("lot", values["median"])).alias("median_lot"))
    return table.join(_supply(derived), "year", "left").withColumn("supply", F.coalesce("supply", F.lit(0)))


def no_comp_years(records: DataFrame, min_comps: int = 1) -> DataFrame:
    """Years with supply that the cost table does not report."""
    priced = comps(records).groupBy("year").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_comps)
    return supply_by_year(records).join(priced, "year", "left_anti").select("year")


def supply_summary(listings: DataFrame) -> DataFrame:
    """One row: listing count, asking statistics, distinct sellers, format mix."""
    priced = listings.where("asking > 0")
    asks = st.order_stats(priced, [], F.col("asking"), {**st.median_ranks("median"), "lo": F.lit(1), "hi": F.col("n")})
    asks = asks.select(F.col("n").alias("ask_n"), st.median_of("median").alias("ask_median"),
                       F.col("lo").alias("ask_min"), F.col("hi").alias("ask_max"))
    sellers = listings.where("seller <> ''").groupBy("seller").agg(F.count(F.lit(1)).alias("c")) \
        .agg(F.count(F.lit(1)).alias("distinct_sellers"))
    mix = listings.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("fmt") == "auction").alias("auction"),
                       F.count_if(F.col("fmt") == "fixed").alias("fixed"),
                       F.count_if(F.col("fmt") == "unknown").alias("unknown"))
    one = F.lit(1).alias("_one")
    joined = mix.select("*", one).join(sellers.select("*", one), "_one").join(asks.select("*", one), "_one", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("ask_n", "ask_median", "ask_min", "ask_max")]
    return joined.select("n", "auction", "fixed", "unknown", "distinct_sellers", *zero)


def supply_bands(listings: DataFrame) -> DataFrame:
    """Priced listings per asking band."""
    return listings.where("asking > 0").groupBy(price_band(F.col("asking")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


def top_sellers(listings: DataFrame, n: int = 8) -> DataFrame:
    """Sellers with most listings; the name settles ties."""
    counted = listings.where("seller <> ''").groupBy("seller").agg(F.count(F.lit(1)).alias("n"))
    return top_n(counted, [F.desc("n"), F.asc("seller")], n)
