"""Allow and deny rules of principals on shared resources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def entitlements(principals: DataFrame, policies: DataFrame) -> DataFrame:
    """Pairs a principal may use, with the options left to it.

    ``principals``: principal, account, groups, options. ``policies``: resource, state,
    deny_groups, deny_accounts, allow_accounts, allow_groups, deny_options, allow_options
    (arrays; empty when unset). Where accounts are listed only they (or ALL) decide, else
    groups do. Pairs come from an equi-join on the allowing token, never from all pairs.
    """
    empty = lambda c: F.size(c) == 0
    usable = policies.where(F.col("state") == "UP")
    token = F.struct(F.lit("account").alias("kind"), F.col("t").alias("name"))
    by_account = usable.where(~empty("allow_accounts")).withColumn("t", F.explode("allow_accounts"))
    group_ruled = usable.where(empty("allow_accounts"))
    # ALL opens a resource to all groups only when it is the whole list.
    open_to_all = (F.size("allow_groups") == 1) & F.array_contains("allow_groups", "ALL")
    named = group_ruled.withColumn("t", F.explode("allow_groups"))
    group_token = F.struct(F.when(open_to_all, "any").otherwise("group").alias("kind"), F.col("t").alias("name"))
    rules = by_account.withColumn("_token", token).unionByName(named.withColumn("_token", group_token)).drop("t")
    mine = F.concat(
        F.array(F.struct(F.lit("account").alias("kind"), F.col("account").alias("name")),
                F.struct(F.lit("account").alias("kind"), F.lit("ALL").alias("name")),
                F.struct(F.lit("any").alias("kind"), F.lit("ALL").alias("name"))),
        F.transform("groups", lambda g: F.struct(F.lit("group").alias("kind"), g.alias("name"))))
    flat = lambda df: df.withColumns({"_kind": F.col("_token.kind"), "_name": F.col("_token.name")}).drop("_token")
    asked = flat(principals.withColumn("_token", F.explode(F.array_distinct(mine))))
    pairs = asked.join(flat(rules), ["_kind", "_name"])
    denied = F.arrays_overlap("deny_groups", "groups") | F.array_contains(F.col("deny_accounts"), F.col("account"))
    all_options = (F.size("allow_options") == 1) & F.array_contains("allow_options", "ALL")
    left = (F.when(~empty("deny_options"), F.array_except("options", "deny_options"))
            .when(all_options, F.col("options"))
            .when(~empty("allow_options"), F.array_intersect("options", "allow_options"))
            .otherwise(F.array().cast("array<string>")))
    return (pairs.where(~F.coalesce(denied, F.lit(False)))
            .select("principal", "resource", F.array_sort(left).alias("options"))
            # Arrays are reduced by sorting; dealt before that, no task sorts all pairs of its part of the principals.
            .repartition("principal", "resource").dropDuplicates(["principal", "resource"]))


def _rule(policies: DataFrame) -> DataFrame:
    """Usable policies with who they open to: rule (everyone, accounts, groups) and the names it lists."""
    by_account = F.size("allow_accounts") > 0
    everyone = (by_account & F.array_contains("allow_accounts", "ALL")) | (
        ~by_account & (F.size("allow_groups") == 1) & F.array_contains("allow_groups", "ALL"))
    return policies.where(F.col("state") == "UP").select(
        "*", F.when(everyone, F.lit("everyone")).when(by_account, F.lit("accounts")).otherwise(F.lit("groups")).alias("rule"),
        F.when(by_account, F.col("allow_accounts")).otherwise(F.col("allow_groups")).alias("names"))


def _classes(principals: DataFrame) -> DataFrame:
    """Principals of the same account and groups as one row, and each name that rules can ask for."""
    grouped = principals.groupBy("account", F.array_sort(F.array_distinct("groups")).alias("groups")).agg(
        F.count_distinct("principal").alias("n"))
    name = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("name"))
    mine = F.concat(F.array(name("accounts", F.col("account"))), F.transform("groups", lambda g: name("groups", g)))
    return grouped.withColumn("_name", F.explode(mine)).select("account", "groups", "n", "_name.kind", "_name.name")


def _denials(rules: DataFrame) -> DataFrame:
    listed = [rules.select("resource", F.lit(kind).alias("kind"), F.explode(column).alias("name"))
              for kind, column in (("accounts", "deny_accounts"), ("groups", "deny_groups"))]
    return listed[0].unionByName(listed[1]).distinct()


def open_policies(principals: DataFrame, policies: DataFrame) -> DataFrame:
    """Entitlements without their pairs: one row per usable policy, its rule, and how many it opens to.

    resource, rule, names, principals (may use it), excluded (the rule opens it to them, a denial closes it).
    Principals count by class (account and groups), and classes meet rules only through names that both list, so
    a policy that is open to everyone costs its denials, not its principals. ``entitlements`` of chosen principals
    expands it. Resources are distinct.
    """
    rules = _rule(policies)
    classes = _classes(principals)
    key = ["resource", "account", "groups", "n"]
    denied = classes.join(_denials(rules), ["kind", "name"]).select(*key).distinct()
    listed = rules.where("rule <> 'everyone'").select("resource", F.col("rule").alias("kind"), F.explode("names").alias("name"))
    named = classes.join(listed.distinct(), ["kind", "name"]).select(*key).distinct()
    marked = named.withColumn("_in", F.lit(1)).unionByName(denied.withColumn("_in", F.lit(2)))
    sides = marked.groupBy(*key).agg(F.sum("_in").alias("_in"))  # 1 named, 2 denied, 3 both
    sums = sides.groupBy("resource").agg(*[F.sum(F.when(F.col("_in") == k, F.col("n"))).alias(c) for k, c in (
        (1, "_named"), (2, "_denied"), (3, "_both"))])
    total = principals.agg(F.count_distinct("principal").alias("_all"))
    everyone = F.col("rule") == "everyone"
    zero = lambda c: F.coalesce(c, F.lit(0))
    return rules.join(sums, "resource", "left").join(F.broadcast(total)).select(  # one number beside every row
        "resource", "rule", F.array_sort("names").alias("names"),
        F.when(everyone, F.col("_all") - zero("_denied")).otherwise(zero("_named")).alias("principals"),
        F.when(everyone, zero("_denied")).otherwise(zero("_both")).alias("excluded"))


def exceptions(principals: DataFrame, policies: DataFrame) -> DataFrame:
    """(resource, principal): whom a policy that is open to everyone leaves out. As many rows as denials reach."""
    rules = _rule(policies).where("rule = 'everyone'")
    name = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("name"))
    mine = F.concat(F.array(name("accounts", F.col("account"))), F.transform("groups", lambda g: name("groups", g)))
    asked = principals.select("principal", F.explode(mine).alias("_name")).select("principal", "_name.kind", "_name.name")
    return asked.join(_denials(rules), ["kind", "name"]).select("resource", "principal").distinct()
