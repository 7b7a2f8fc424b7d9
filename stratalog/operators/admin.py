"""Identities put together from what was read, and whether each is an administrator or can become one.

What a statement is worth is worked out once for each policy, however many identities have it; identities then meet their
policies by an equi join and add up flags. Only rules about an identity's own name look at identity and statement together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..adapters import POLICY, derived, duck
from ..functions.wild import wild, wild_match
from .policy import ESCALATION, LAUNCH, _all_wild, broad, statements

IAM_ESCALATION = [a for a in ESCALATION if a.startswith("iam:")]
# What hands out new permissions on an identity's own name.
SELF_GRANT = {"user": ["iam:AttachUserPolicy", "iam:PutUserPolicy"], "role": ["iam:AttachRolePolicy", "iam:PutRolePolicy"]}
OWN_NAME = r"(?i)\$\{aws:username\}"
SERVICE_LINKED, SIGN_ON = "/aws-service-role/", "/aws-reserved/sso.amazonaws.com/"


def allowed(catalog: list[str]) -> Column:
    """The actions of a catalog that the statement allows, in order; NotAction allows what it doesn't list. Expects the
    patterns' expressions in yes and no."""
    named = lambda patterns, a: F.exists(patterns, lambda p: F.rlike(F.lit(a.lower()), p))
    hit = lambda a: F.when(F.size("no") > 0, ~named("no", a)).otherwise(named("yes", a))
    return F.filter(F.array(*(F.when(hit(a), a) for a in sorted(catalog))), lambda a: a.isNotNull())


def facts(stmts: DataFrame) -> DataFrame:
    """policy_id, stmt and what an Allow statement is worth: admin, escalation (on any identity), passes (any role), pairs
    (actions that run as a passed role), and for narrow ones names and self_user, self_role: what they hand out on them."""
    every = F.col("not_resource") | F.exists("resources", lambda r: _all_wild(F.trim(r)) | (F.trim(r) == "arn:*") | F.trim(r).rlike(r"^arn:(\*|[\w-]+):\*(:\*?)*$"))
    star = F.exists("actions", lambda a: F.trim(a).isin("*", "*:*"))
    service = lambda r: F.get(F.split(F.trim(r), ":", 4), 2)
    iam = lambda r: ~F.trim(r).startswith("arn:") & (F.trim(r) != "arn") | service(r).isNull() | (F.lower(service(r)) == "iam") | service(r).rlike("[*?]")
    globs = lambda c: F.transform(c, lambda p: wild(F.lower(p)))
    s = stmts.where("effect = 'Allow'").withColumns({"yes": globs("actions"), "no": globs("not_actions")})
    s = s.select("policy_id", "stmt", "actions", "not_actions", "not_resource", "resources", allowed(IAM_ESCALATION).alias("esc"), allowed(["iam:PassRole"]).alias("pass"), allowed(LAUNCH).alias("pairs"), *(allowed(v).alias(f"self_{k}") for k, v in SELF_GRANT.items()), every.alias("every"), star.alias("star"))
    own, others = F.filter("resources", lambda r: r.rlike(OWN_NAME)), F.filter("resources", lambda r: ~r.rlike(OWN_NAME) & iam(r))
    wide = broad(others) | F.col("not_resource")
    # Everything but a list is everything where the list takes none of the escalation away.
    admin = F.col("every") & (F.col("star") | (F.size("not_actions") > 0) & (F.size("esc") == len(IAM_ESCALATION)))
    s = s.withColumns({"admin": admin, "wide": wide, "names": F.concat(own, others)})
    none = F.array().cast("array<string>")
    keep = lambda c, test: F.when(~F.col("admin") & test, F.col(c)).otherwise(none)
    return s.select(
        "policy_id", "stmt", "admin", (F.size(keep("esc", F.col("wide"))) > 0).alias("escalation"), (F.size(keep("pass", F.col("wide"))) > 0).alias("passes"), keep("pairs", F.lit(True)).alias("pairs"), keep("names", ~F.col("wide")).alias("names"),
        (F.size("self_user") > 0).alias("self_user"), (F.size("self_role") > 0).alias("self_role"),
    )


def is_own(resource: Column, arn: Column, kind: Column) -> Column:
    """Could the resource be the identity itself. Only users have a name to fill in."""
    named = resource.rlike(OWN_NAME)
    filled = F.regexp_replace(F.trim(resource), OWN_NAME, F.element_at(F.split(arn, "/"), -1))
    return F.when(F.coalesce(arn, F.lit("")) == "", (kind == "user") & named).when(named & (kind != "user"), False).otherwise(wild_match(F.lower(filled), F.lower(arn)))


def verdicts(identities: DataFrame, sources: DataFrame, policy_facts: DataFrame) -> DataFrame:
    """id, admin (yes, can become, no, or null where an unreadable policy leaves it open), reasons and policies to blame.
    Identities are (id, arn, kind); sources (id, ord, policy_id, readable), own, inline and through groups, in order."""
    j = sources.join(identities, "id").join(policy_facts, "policy_id", "left")
    grants = F.when(F.col("kind") == "role", F.col("self_role")).otherwise(F.col("self_user"))
    mine = F.coalesce(grants & F.exists("names", lambda r: is_own(r, F.col("arn"), F.col("kind"))), F.lit(False))
    is_ = lambda c: F.coalesce(F.col("readable") & F.col(c), F.lit(False))
    j = j.select("id", "ord", "policy_id", "readable", is_("admin").alias("admin"), is_("escalation").alias("esc"), is_("passes").alias("passes"), (F.col("readable") & mine).alias("own"), F.when(F.col("readable"), F.get("pairs", 0)).alias("pair"))
    blamed = lambda test: F.collect_set(F.when(test, F.col("policy_id")))
    g = j.groupBy("id").agg(
        F.bool_or("admin").alias("is_admin"), F.bool_or(F.col("esc")).alias("esc"), F.bool_or("own").alias("own"), F.bool_or("passes").alias("passes"), F.min("pair").alias("pair"), F.bool_or(~F.col("readable")).alias("open"), blamed(F.col("admin")).alias("by_admin"), blamed(F.col("esc") | F.col("own")).alias("by_esc"),
        F.min_by("policy_id", F.when(F.col("passes"), F.col("ord"))).alias("by_pass"), F.min_by("policy_id", F.when(F.col("pair").isNotNull(), F.struct("pair", "ord"))).alias("by_pair"),
    )
    both = F.coalesce(F.col("passes") & F.col("pair").isNotNull(), F.lit(False))
    verdict = F.when(F.col("is_admin"), "yes").when(F.col("esc") | F.col("own") | both, "can become").when(F.col("open"), None).otherwise("no")
    reasons = F.when(F.col("is_admin"), F.array(F.lit("admin"))).otherwise(F.filter(F.array(F.when(F.col("esc"), "escalation"), F.when(F.col("own"), "own name"), F.when(both, F.concat(F.lit("pass role and "), "pair"))), lambda x: x.isNotNull()))
    pair = F.when(both, F.array("by_pass", "by_pair")).otherwise(F.array().cast("array<bigint>"))
    blame = F.when(F.col("is_admin"), F.col("by_admin")).otherwise(F.array_distinct(F.concat("by_esc", pair)))
    shown = g.select("id", verdict.alias("admin"), F.array_join(reasons, "; ").alias("reasons"), F.array_join(F.array_sort(blame), ",").alias("policies"))
    return identities.select("id").join(shown, "id", "left").select("id", F.when(F.col("reasons").isNull(), "no").otherwise(F.col("admin")).alias("admin"), F.coalesce("reasons", F.lit("")).alias("reasons"), F.coalesce("policies", F.lit("")).alias("policies"))


def identities(account: str, users: DataFrame, roles: DataFrame, report: DataFrame, summary: DataFrame) -> DataFrame:
    """kind, name, arn, created, in_report, console, mfa, keys, made_by of the root, every user and every role.

    Users are (name, arn, created), or none where they couldn't be listed: then the report's rows stand in. The report
    (user, arn, created, password_enabled, mfa_active, keys) may be hours old, so what the live summary (mfa, keys, one row
    or none) says of the root goes before it. The root's password always works."""
    r = report.select("user", *(F.col(c).alias(f"r_{c}") for c in ("arn", "created", "password_enabled", "mfa_active", "keys")))
    listed = users.select("name", "arn", "created", F.lit(True).alias("listed"))
    own = r.where("user <> '<root_account>'").withColumnRenamed("user", "name")
    any_listed = users.agg((F.count("*") > 0).alias("any_listed"))
    u = listed.join(own.withColumn("in_report", F.lit(True)), "name", "full").join(F.broadcast(any_listed)).where("listed OR NOT any_listed")
    none = F.lit(None).cast("string")
    people = u.select(F.lit("user").alias("kind"), "name", F.coalesce("arn", "r_arn").alias("arn"), F.coalesce("created", "r_created").alias("created"), F.coalesce("in_report", F.lit(False)).alias("in_report"), F.coalesce("r_password_enabled", F.lit(False)).alias("console"), F.coalesce("r_mfa_active", F.lit(False)).alias("mfa"), F.coalesce("r_keys", F.lit(0)).cast("bigint").alias("keys"), none.alias("made_by"))
    live = summary.select(F.col("mfa").alias("s_mfa"), F.col("keys").alias("s_keys"), F.lit(1).alias("one"))
    root = r.where("user = '<root_account>'").withColumn("one", F.lit(1)).join(live, "one", "full")
    # Keys that the summary still counts but the report doesn't are one at least.
    keys = F.when(F.col("s_keys").isNull(), F.col("r_keys")).when(F.col("s_keys") == 0, 0).otherwise(F.greatest(F.coalesce("r_keys", F.lit(0)), F.lit(1)))
    top = root.select(F.lit("root").alias("kind"), F.lit("root").alias("name"), F.coalesce("r_arn", F.lit(f"arn:aws:iam::{account}:root")).alias("arn"), F.col("r_created").alias("created"), F.col("user").isNotNull().alias("in_report"), F.lit(True).alias("console"), F.coalesce("s_mfa", "r_mfa_active").alias("mfa"), keys.cast("bigint").alias("keys"), none.alias("made_by"))
    made = F.when(F.col("path").startswith(SERVICE_LINKED), "service-linked").when(F.col("path").startswith(SIGN_ON), "identity center")
    machines = roles.select(F.lit("role").alias("kind"), "name", "arn", "created", F.lit(False).alias("in_report"), F.lit(False).alias("console"), F.lit(False).alias("mfa"), F.lit(0).cast("bigint").alias("keys"), made.alias("made_by"))
    return top.unionByName(people).unionByName(machines)


# Queries and their SQL

_POLICIES = "(SELECT CAST(floor(count(*) / 4) AS BIGINT) FROM $part)"
_KIND = "CASE WHEN c_custkey % 3 = 0 THEN 'role' ELSE 'user' END"
IDENTITIES = f"SELECT CAST(c_custkey AS BIGINT) AS id, CASE WHEN c_custkey % 29 = 1 THEN NULL ELSE 'arn:aws:iam::111122223333:' || {_KIND} || '/' || CASE WHEN c_custkey % 7 = 0 THEN 'app' ELSE 'n' || CAST(c_custkey AS VARCHAR(20)) END END AS arn, {_KIND} AS kind FROM $customer"
#: Own policies, inline ones, and those of the identity's group.
SOURCES = f"""SELECT id, ord, policy_id, policy_id % 13 <> 5 AS readable FROM (SELECT CAST(c_custkey AS BIGINT) AS id, 1 AS ord, CAST(c_custkey * 3 % {_POLICIES} AS BIGINT) AS policy_id FROM $customer WHERE c_custkey % 5 < 4
UNION ALL SELECT CAST(c_custkey AS BIGINT), 2, CAST((c_custkey * 5 + 1) % {_POLICIES} AS BIGINT) FROM $customer WHERE c_custkey % 4 = 0 UNION ALL SELECT CAST(c_custkey AS BIGINT), 3 + k, CAST((c_nationkey % 6 * 7 + k * 5) % {_POLICIES} AS BIGINT) FROM $customer, (VALUES (0), (1)) AS g(k) WHERE c_custkey % 3 = 1 AND c_nationkey % 6 <> 2) x"""
#: Statements that name their bearer beside the policies of the other queries.
STATEMENTS = f"""SELECT policy_id, stmt, sid, version, effect, CASE WHEN policy_id % 6 = 2 AND stmt = 1 THEN 'iam:Put*' WHEN policy_id % 10 = 7 AND stmt = 2 THEN 'iam:PassRole' ELSE actions END AS actions, CASE WHEN policy_id % 6 = 2 AND stmt = 1 OR policy_id % 10 = 7 AND stmt = 2 THEN NULL ELSE not_actions END AS not_actions,
CASE WHEN policy_id % 6 = 2 AND stmt = 1 THEN CASE policy_id % 4 WHEN 0 THEN 'arn:aws:iam::*:user/${{aws:username}}' ELSE 'arn:aws:iam::111122223333:role/app,arn:aws:s3:::b' END WHEN policy_id % 10 = 7 AND stmt = 2 THEN '*' ELSE resources END AS resources, CASE WHEN policy_id % 6 = 2 AND stmt = 1 OR policy_id % 10 = 7 AND stmt = 2 THEN NULL ELSE not_resources END AS not_resources,
aws, services, federated, has_principal, not_principal, cond_op, cond_key, cond_values FROM ({POLICY}) p WHERE policy_id % 8 <> 3"""
USERS = "SELECT 'u' || CAST(c_custkey AS VARCHAR(20)) AS name, 'arn:aws:iam::111122223333:user/u' || CAST(c_custkey AS VARCHAR(20)) AS arn, CAST(c_custkey % 900 AS BIGINT) AS created FROM $customer WHERE c_custkey % 4 <> 1"
ROLES = "SELECT 'r' || CAST(s_suppkey AS VARCHAR(20)) AS name, 'arn:aws:iam::111122223333:role/r' || CAST(s_suppkey AS VARCHAR(20)) AS arn, CAST(s_suppkey % 900 AS BIGINT) AS created, CASE s_suppkey % 4 WHEN 0 THEN '/aws-service-role/x.amazonaws.com/' WHEN 1 THEN '/aws-reserved/sso.amazonaws.com/eu/' ELSE '/' END AS path FROM $supplier"
REPORT = "SELECT CASE WHEN c_custkey = 1 THEN '<root_account>' ELSE 'u' || CAST(c_custkey AS VARCHAR(20)) END AS user_, 'arn:aws:iam::111122223333:user/' || CAST(c_custkey AS VARCHAR(20)) AS arn, CAST(c_custkey % 800 AS BIGINT) AS created, c_custkey % 2 = 0 AS password_enabled, c_custkey % 3 = 1 AS mfa_active, CAST(c_custkey % 3 AS BIGINT) AS keys_ FROM $customer WHERE c_custkey % 7 <> 5"


def _identities(spark, sf_dir):
    t = lambda q: derived(spark, sf_dir, q)
    summary = t("SELECT min(c_custkey) > 1 AS mfa, count(*) AS keys_ FROM $customer").withColumnRenamed("keys_", "keys")
    return identities("111122223333", t(USERS), t(ROLES), t(REPORT).withColumnsRenamed({"user_": "user", "keys_": "keys"}), summary)


QUERIES = {
    "cred_admin": lambda spark, sf_dir: verdicts(derived(spark, sf_dir, IDENTITIES), derived(spark, sf_dir, SOURCES), facts(statements(derived(spark, sf_dir, STATEMENTS)))),
    "cred_identities": _identities,
}
_grants = lambda action: f"CASE WHEN len(not_actions) > 0 THEN len(list_filter(not_actions, lambda p: lower({action}) GLOB lower(p))) = 0 ELSE len(list_filter(actions, lambda p: lower({action}) GLOB lower(p))) > 0 END"
_any = lambda actions: "(" + " OR ".join(f"({_grants(repr(a))})" for a in actions) + ")"
_cut = lambda c: f"CASE WHEN coalesce({c}, '') = '' THEN CAST([] AS VARCHAR[]) ELSE string_split({c}, ',') END AS {c}"
_WIDE = r"""(regexp_full_match(r, '[*?]+') OR (r LIKE 'arn:%' AND CASE WHEN len(string_split(r, ':')) < 6 THEN regexp_matches(string_split(r, ':')[-1], '[*?]') ELSE regexp_matches(string_split(r, ':')[2] || string_split(r, ':')[3] || string_split(r, ':')[5], '[*?]') OR regexp_full_match(regexp_extract(r, '^(?:[^:]*:){5}(.*)$', 1), '[*?]+')
 OR (string_split(r, ':')[3] = 's3' AND regexp_matches(string_split(r, ':')[6], '^[*?]')) OR (string_split(r, ':')[3] NOT IN ('s3', 'sqs', 'sns', 'codecommit') AND regexp_full_match(regexp_extract(r, '^(?:[^:]*:){5}(.*)$', 1), '[\w-]+[/:]\*|[a-z][a-z-]*\*')) END))"""
_IAM = "(r NOT LIKE 'arn:%' OR len(string_split(r, ':')) < 3 OR string_split(r, ':')[3] = 'iam' OR regexp_matches(string_split(r, ':')[3], '[*?]'))"
ORACLES = {
    "cred_admin": f"""WITH s AS (SELECT policy_id, stmt, {_cut('actions')}, {_cut('not_actions')}, {_cut('resources')}, not_resources IS NOT NULL AS nr FROM ({duck(STATEMENTS)}) WHERE lower(effect) = 'allow'),
o AS (SELECT *, list_filter(resources, lambda r: r LIKE '%${{aws:username}}%') AS mine, list_filter(resources, lambda r: r NOT LIKE '%${{aws:username}}%' AND {_IAM}) AS others, nr OR len(list_filter(resources, lambda r: r IN ('*', 'arn:*'))) > 0 AS every FROM s),
a AS (SELECT *, every AND (len(list_intersect(actions, ['*', '*:*'])) > 0 OR len(not_actions) > 0 AND NOT ({' OR '.join(f"NOT ({_grants(repr(x))})" for x in IAM_ESCALATION)})) AS adm, nr OR len(list_filter(others, lambda r: {_WIDE})) > 0 AS wide FROM o),
f AS (SELECT policy_id, stmt, adm, NOT adm AND wide AND {_any(IAM_ESCALATION)} AS esc, NOT adm AND wide AND {_any(['iam:PassRole'])} AS pass, CASE WHEN adm OR wide THEN CAST([] AS VARCHAR[]) ELSE list_concat(mine, others) END AS names, {_any(SELF_GRANT['user'])} AS su, {_any(SELF_GRANT['role'])} AS sr,
 CASE WHEN NOT adm THEN list_min(list_filter([{', '.join(f"CASE WHEN {_grants(repr(x))} THEN '{x}' END" for x in LAUNCH)}], lambda x: x IS NOT NULL)) END AS pair FROM a),
i AS ({duck(IDENTITIES)}), j AS (SELECT i.id, i.arn, i.kind, q.ord, q.policy_id, q.readable, f.* EXCLUDE (policy_id) FROM i JOIN ({duck(SOURCES)}) q USING (id) LEFT JOIN f ON f.policy_id = q.policy_id AND q.readable),
n AS (SELECT *, coalesce(CASE kind WHEN 'role' THEN sr ELSE su END AND len(list_filter(names, lambda r: CASE WHEN arn IS NULL THEN kind = 'user' AND r LIKE '%${{aws:username}}%' WHEN r LIKE '%${{aws:username}}%' AND kind <> 'user' THEN false ELSE lower(arn) GLOB lower(replace(r, '${{aws:username}}', split_part(arn, '/', -1))) END)) > 0, false) AS own FROM j),
g AS (SELECT id, coalesce(bool_or(adm), false) AS adm, coalesce(bool_or(esc), false) AS esc, bool_or(own) AS own, coalesce(bool_or(pass), false) AND min(pair) IS NOT NULL AS both_, min(pair) AS pair, bool_or(NOT readable) AS open_, list(DISTINCT policy_id) FILTER (adm) AS b1, list(DISTINCT policy_id) FILTER (esc OR own) AS b2, arg_min(policy_id, ord) FILTER (pass) AS b3, arg_min(policy_id, (pair, ord)) FILTER (pair IS NOT NULL) AS b4 FROM n GROUP BY id)
SELECT i.id, CASE WHEN g.id IS NULL THEN 'no' WHEN adm THEN 'yes' WHEN esc OR own OR both_ THEN 'can become' WHEN NOT open_ THEN 'no' END AS admin, coalesce(CASE WHEN adm THEN 'admin' ELSE concat_ws('; ', CASE WHEN esc THEN 'escalation' END, CASE WHEN own THEN 'own name' END, CASE WHEN both_ THEN 'pass role and ' || pair END) END, '') AS reasons,
coalesce(array_to_string(list_sort(CASE WHEN adm THEN b1 WHEN both_ THEN list_distinct(list_concat(coalesce(b2, []), [b3, b4])) ELSE b2 END), ','), '') AS policies FROM i LEFT JOIN g ON g.id = i.id""",
    "cred_identities": f"""WITH u AS ({duck(USERS)}), r AS ({duck(REPORT)}) SELECT 'root' AS kind, 'root' AS name, arn, created, true AS in_report, true AS console, false AS mfa, greatest(keys_, 1) AS keys, NULL AS made_by FROM r WHERE user_ = '<root_account>'
UNION ALL SELECT 'user', name, u.arn, u.created, r.user_ IS NOT NULL, coalesce(password_enabled, false), coalesce(mfa_active, false), coalesce(keys_, 0), NULL FROM u LEFT JOIN r ON r.user_ = u.name
UNION ALL SELECT 'role', name, arn, created, false, false, false, 0, CASE WHEN path LIKE '/aws-service-role/%' THEN 'service-linked' WHEN path LIKE '/aws-reserved/%' THEN 'identity center' END FROM ({duck(ROLES)})""",
}
