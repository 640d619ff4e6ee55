"""Inputs of the registered queries, derived from the given tables with Spark.

The corpus has no Chinese entities, so `ledger` writes one sentence per order that carries
names, dates, amounts, phone, identity and card numbers taken from the order itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.session import deal, spread
from veilwork.sources.units import units_from_table

# Words the example runs treat as harmless.
WHITELIST = ("NATION_3", "NATION_7", "NATION_11", "NATION_19", "NATION_23")

LEDGER_TEXT = """
concat('甲方', c_name, '（', n_name, '）与Supplier#', lpad(cast(o_orderkey % 100 as string), 9, '0'), '于',
  year(o_orderdate), '年', month(o_orderdate), '月', day(o_orderdate), '日签订', o_orderkey, '号订单，合同价人民币 ',
  cents div 100, '.', lpad(cast(cents % 100 as string), 2, '0'), '元，首付', cents div 1000000, '.',
  lpad(cast((cents div 10000) % 100 as string), 2, '0'), '万元，电话',
  case when o_orderkey % 5 = 0 then '+86' else '' end, '1', 3 + o_orderkey % 7,
  lpad(cast((o_custkey * 7919 + o_orderkey) % 1000000000 as string), 9, '0'), '，证件11010119',
  lpad(cast(o_custkey % 100 as string), 2, '0'), '0101', lpad(cast(o_orderkey % 1000 as string), 3, '0'),
  case when o_orderkey % 11 = 10 then 'X' else cast(o_orderkey % 11 as string) end, '，卡号6222 0202 ',
  lpad(cast(o_custkey % 10000 as string), 4, '0'), ' ', lpad(cast(o_orderkey % 10000 as string), 4, '0'),
  '，邮箱c', o_custkey, '@example.com。')
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return units_from_table(d, F.col("source"), F.col("doc_id"), F.lit(0), F.col("text"))


def conversation_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spread(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"))
    return units_from_table(c, F.concat(F.lit("conv/"), "conv_id"), F.col("conv_id"), F.col("turn"), F.col("text"))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sentence per order; a customer's orders form a file."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    joined = (o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
              .withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("long"))
              .select("o_orderkey", "o_custkey", "o_orderdate", "c_name", "n_name", "cents"))
    joined = deal(joined, o.count())  # texts are made, and searched, in the tasks they are dealt to
    return units_from_table(joined, F.concat(F.lit("ledger/"), "o_custkey"), F.col("o_custkey"), F.col("o_orderkey"), F.expr(LEDGER_TEXT))


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of suppliers, customers, brands, nations and regions by category."""
    def part(name, category, cat_ord, word, word_ord):
        return table(spark, sf_dir, name).select(
            F.lit(category).alias("category"), F.lit(cat_ord).alias("cat_ord"), F.col(word).alias("word"),
            F.expr(word_ord).cast("long").alias("word_ord"))
    return (part("supplier", "company", 0, "s_name", "s_suppkey")
            .unionByName(part("customer", "person", 2, "c_name", "c_custkey"))
            .unionByName(part("part", "project", 3, "p_brand", "substring(p_brand, 7)").distinct())
            .unionByName(part("nation", "location", 5, "n_name", "n_nationkey"))
            .unionByName(part("region", "location", 5, "r_name", "100 + r_regionkey")))


def memo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier notes that already contain placeholder-shaped strings."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    joined = s.join(n, s.s_nationkey == n.n_nationkey)
    text = F.expr("""concat('供方', s_name, '（', n_name, '）编号', format_string('[COMPANY_%03d]', s_suppkey * 2),
        '，旧号', format_string('[LOCATION_%04d]', s_suppkey), '，备用', format_string('[LOCATION_%03d]', s_suppkey % 40))""")
    return units_from_table(joined, F.concat(F.lit("memo/"), "s_nationkey"), F.col("s_nationkey"), F.col("s_suppkey"), text)


def tokened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked-looking order lines: known placeholders, except in pending orders."""
    text = F.expr("""case when o_orderstatus = 'P' then concat('订单', o_orderkey, '见[SUBJECT_007]')
        else concat('客户', format_string('[PERSON_%03d]', o_custkey + 1), '付', format_string('[AMOUNT_%03d]', o_orderkey + 1),
                    '，客户', format_string('[PERSON_%03d]', o_custkey + 1), '另见[SUBJECT_007]') end""")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    o = deal(o, o.count())
    return units_from_table(o, F.concat(F.lit("f/"), "o_custkey"), F.col("o_custkey"), F.col("o_orderkey"), text)


def token_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapping of `tokened`: people by name, amounts by order value (kind number)."""
    c = table(spark, sf_dir, "customer").selectExpr(
        "format_string('[PERSON_%03d]', c_custkey + 1) token", "c_name original", "'person' type", "0.95D confidence", "'text' kind")
    cents = "cast(round(o_totalprice * 100) as bigint)"
    o = table(spark, sf_dir, "orders").selectExpr(
        "format_string('[AMOUNT_%03d]', o_orderkey + 1) token",
        f"concat({cents} div 100, '.', lpad(cast({cents} % 100 as string), 2, '0')) original", "'amount' type", "0.85D confidence", "'number' kind")
    return c.unionByName(o)


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file tree: region / nation / one contract file per customer."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    path = F.expr("""concat(r_name, '/', n_name, '/', c_name, '-合同', case c_custkey % 4
        when 0 then concat(c_custkey, '万') when 1 then concat('1380000', lpad(cast(c_custkey % 10000 as string), 4, '0'))
        when 2 then concat('621700000000', lpad(cast(c_custkey % 10000 as string), 4, '0')) else '' end,
        case c_custkey % 5 when 0 then '.docx' when 1 then '.xlsx' when 2 then '.PDF' when 3 then '.pptx' else '' end)""")
    return (c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(path.alias("path")))


def path_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rename records of a tree: folders by nation, files by customer."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    files = c.join(n, c.c_nationkey == n.n_nationkey).selectExpr(
        "'file' kind", "concat(c_name, '.docx') old_name", "format_string('[PERSON_%03d].docx', c_custkey div 2 * 2 + 1) new_name",
        "concat(n_name, '/', c_name, '.docx') rel_old",
        "concat(format_string('[LOCATION_%03d]', n_nationkey + 1), '/', format_string('[PERSON_%03d].docx', c_custkey div 2 * 2 + 1)) rel_new",
        "2 depth", "case when c_custkey % 9 = 0 then 'skipped' when c_custkey % 2 = 1 then 'conflict_suffixed' else 'renamed' end status",
        "c_custkey + 1000 ord")
    dirs = n.selectExpr(
        "'dir' kind", "n_name old_name", "format_string('[LOCATION_%03d]', n_nationkey + 1) new_name", "n_name rel_old",
        "format_string('[LOCATION_%03d]', n_nationkey + 1) rel_new", "1 depth", "'renamed' status", "cast(n_nationkey as bigint) ord")
    return files.unionByName(dirs)


def number_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices with alternating formats (a double per line item)."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey", "l_quantity")
    return li.selectExpr(
        "l_orderkey * 10 + l_linenumber cell", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice * 7.5D value",
        "case l_orderkey % 3 when 0 then '¥#,##0.00' when 1 then 'General' else '[$€-407]#,##0' end number_format")


def whole_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole numbers of 10 to 17 digits, one per order."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey cell",
        "case o_orderkey % 3 when 0 then 4000000000000000 + o_orderkey * 7919 when 1 then 1000000000 + o_orderkey else 12345678901234567 + o_orderkey end value",
        "case when o_orderkey % 7 = 0 then '$0' else 'General' end number_format")


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of part names and types with a tag that follows from their length."""
    text = F.expr("split(concat(p_name, ' ', p_type, case p_size % 3 when 0 then '公司' when 1 then '银行' else '' end), ' ')")
    flags = F.array(*[F.lit(x) for x in ("nr", "nrfg", "nrt", "ns", "nsf", "nt", "ni", "nis", "nic", "nz", "x")])
    p = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(text).alias("ord", "word"))
    return p.select(F.lit("part").alias("file"), F.lit(0).cast("long").alias("file_ord"), F.col("p_partkey").alias("unit_ord"), "ord", "word",
                    F.element_at(flags, (F.pmod(F.length("word") + F.col("p_partkey"), F.lit(11)) + 1).cast("int")).alias("flag"))
