"""Secrets and personal data in text: find spans, settle overlaps, cover them, count them."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import between, entropy, let, luhn, masked, mixed, pseudonym, spans, swept

# Shapes are rows of plain values; ``Shape.pattern`` is the one place that makes regular expressions of them.

ALPHABET = {
    "upper": "A-Z0-9",
    "lower": "a-z0-9",
    "alnum": "A-Za-z0-9",
    "name": "A-Za-z0-9_-",
    "base64": "A-Za-z0-9+/=",
    "hex": "0-9a-f",
    "digit": "0-9",
    "host": "a-z0-9.-",
    "arn": r"\w+=,.@-",
    "path": r"\w+=,.@/-",
    "query": r"^&\s\"'<>#\\,",
    "word": r"^\s\"'",
}


@dataclass(frozen=True)
class Shape:
    """``lead`` must stand before the covered part and is not covered; ``body`` or, instead, any of ``heads`` followed by
    ``least`` to ``most`` characters of an alphabet is covered; ``tail`` must follow. No character of ``edge`` may stand
    on either side. ``needs`` are words of which a text has one (lower case), or the name of a test in NEEDS."""

    category: str
    label: str
    heads: tuple[str, ...] = ()
    alphabet: str = "alnum"
    least: int = 1
    most: int | None = None
    lead: str = ""
    body: str = ""
    tail: str = ""
    edge: str = r"\w"
    needs: tuple[str, ...] | str = ()
    check: str | None = None

    def pattern(self) -> str:
        heads = "|".join(re.escape(h) for h in self.heads)
        run = f"[{ALPHABET[self.alphabet]}]{{{self.least},{'' if self.most is None else self.most}}}"
        body = self.body or (f"(?:{heads}){run}" if heads else run)
        before = f"(?<![{self.edge}])" if self.edge and not self.lead else ""
        after = f"(?![{self.edge}])" if self.edge and not self.tail else ""
        return f"{before}{self.lead}({body}){self.tail}{after}"


#: Prefixes of identifiers, of tokens and of resources, as their makers publish them.
RESOURCE_KINDS = (
    "acl aclassoc ami cgw cr cvpn-endpoint dopt eigw eipalloc eipassoc eni eni-attach fl fleet fs fsap fsmt i igw ins ipam ipam-pool ipam-scope key lgw lt nat pcx pl ps rtb rtbassoc sg sgr "
    "sir snap ssoins subnet tgw tgw-attach tgw-rtb vgw vol vpc vpc-flow-log vpce vpce-svc vpn"
).split()
UNIQUE_ID_HEADS = ("ABIA", "ACCA", "AGPA", "AIDA", "AIPA", "ANPA", "ANVA", "APKA", "AROA", "ASCA")
SESSION_HEADS = ("FQoGZXIvYXdz", "FwoGZXIvYXdz", "IQoJb3JpZ2lu")
TOKEN_HEADS = (
    (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "alnum", 36, None),
    (("github_pat_",), "name", 40, None),
    (("glpat-",), "name", 20, None),
    (("xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-"), "name", 10, None),
    (("sk-", "sk-ant-", "sk-proj-"), "name", 20, None),
    (("sk_live_", "sk_test_", "rk_live_", "rk_test_"), "alnum", 16, None),
    (("AIza",), "name", 35, 35),
)
SECRET_NAMES = ("api_key", "apikey", "credential", "passphrase", "passwd", "password", "private_key", "privatekey", "secret", "token")
AUTH_SCHEMES = ("Basic", "Bearer", "Negotiate", "NTLM", "Token", "ApiKey", "Api-Key", "SSWS")
REGION = r"[a-z]{2}(?:-gov)?-[a-z]+-\d"
#: A setting's name, its sign, and white space between them.
SETTING = rf"(?i:[\w.-]*(?:{'|'.join(SECRET_NAMES)})s?)[\"']?[ \t]*[:=][ \t]*"
KEY_LINE = r"-----{} [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----"
#: Tests that several shapes share, worked out once for each text.
NEEDS = {"digits": r"\d{3}", "long": r"[A-Za-z0-9+/=_-]{40}", "mac": r"[0-9A-Fa-f]{2}[:-][0-9A-Fa-f]{2}[:-]|[0-9a-f]{4}\.[0-9a-f]{4}\.", "six": r"[0-9A-Fa-f]{0,4}:[0-9A-Fa-f]{0,4}:"}

SHAPES = (
    # Keys: up to the end line where there is one, or as far as lines of key material go.
    Shape("private_keys", "key-block", body=KEY_LINE.format("BEGIN") + r"(?:[^-]*+(?:-(?!----(?:BEGIN|END) )[^-]*+)*+" + KEY_LINE.format("END") + r"|(?:\s*[A-Za-z0-9+/=]{16,}+)*+)", edge="", needs=("private key",)),
    Shape("private_keys", "putty-key", body=r"PuTTY-User-Key-File-\d[\s\S]*?Private-MAC: *[0-9a-f]+", edge="", needs=("putty-user-key-file",)),
    Shape("ssh_keys", "ssh-key", lead=r"\b(?:(?:sk-)?ssh-[a-z0-9]+|ecdsa-sha2-nistp\d{3})(?:@openssh\.com)?[ \t]+", body=r"AAAA[A-Za-z0-9+/=]{20,}(?:[ \t]+[^\s\"',]+)?", edge="", needs=("ssh-", "ecdsa-")),
    # Tokens with a head of their own.
    *(Shape("tokens", "token", heads=h, alphabet=a, least=n, most=m, needs=tuple(x.lower() for x in h)) for h, a, n, m in TOKEN_HEADS),
    Shape("tokens", "jwt", body=r"eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{8,}", needs=("eyj",)),
    Shape("tokens", "token", body=r"[A-Za-z0-9]{14}\.atlasv1\.[\w-]{60,}", needs=(".atlasv1.",)),
    Shape("tokens", "token", lead=rf"(?i:authorization)[\\\"']*[ \t]*[:=][ \t]*[\\\"']*[ \t]*(?i:{'|'.join(AUTH_SCHEMES)})[ \t]+", body=r"[^\s\"'\\,;]+", edge="", needs=("authorization",)),
    Shape("tokens", "token", alphabet="base64", body=r"[A-Za-z0-9/+=_-]{100,}", edge="A-Za-z0-9/+=_-", needs="long", check="long"),
    Shape("aws_keys", "access-key", heads=("AKIA", "ASIA"), alphabet="upper", least=16, most=16, edge="A-Z0-9", needs=("akia", "asia")),
    Shape("aws_keys", "session-token", heads=SESSION_HEADS, alphabet="base64", least=40, edge="A-Za-z0-9/+", needs=tuple(x.lower() for x in SESSION_HEADS)),
    *(Shape("aws_keys", label, lead=rf"(?i:\b{name})=", alphabet="query", edge="", needs=(name.lower() + "=",)) for name, label in (("X-Amz-Security-Token", "session-token"), ("Signature", "signature"), ("X-Amz-Credential", "access-key"))),
    Shape("aws_keys", "secret-key", body=r"[A-Za-z0-9/+]{40}", edge="A-Za-z0-9/+=", needs="long", check="secret40"),
    Shape("iam_ids", "unique-id", heads=UNIQUE_ID_HEADS, alphabet="upper", least=16, edge="A-Z0-9", needs=tuple(x.lower() for x in UNIQUE_ID_HEADS)),
    # Passwords in addresses, commands and settings.
    Shape("url_creds", "url-login", lead="://", body=r"[^/\s:@\"']{1,256}:[^\s@\"']{1,256}", tail="(?=@)", edge="", needs=("://",), check="url"),
    Shape("secret_values", "command-password", lead=r"\b(?:mysql|mysqldump|mysqladmin)\b(?:(?! -p|\bmysql)[^\n])*+ -p", alphabet="word", edge="", needs=("mysql",)),
    Shape("secret_values", "command-password", lead=r"\blogin\b(?:(?! -p[ =]|\blogin\b)[^\n])*+ -p[ =]", alphabet="word", edge="", needs=("login",)),
    Shape("secret_values", "command-password", lead=r"--(?i:password|passwd|token|secret|api-key)[ =]", alphabet="word", edge="", needs=("--pass", "--tok", "--sec", "--api"), check="value"),
    *(Shape("secret_values", "setting", lead=SETTING + q, body=rf"[^{q}\n]+", edge="", needs=SECRET_NAMES, check="value") for q in ('"', "'")),
    Shape("secret_values", "setting", lead=SETTING, body=r"[^\s\"'&{\[(][^\s\"'&]{5,}", edge="", needs=SECRET_NAMES, check="value"),
    # Names and numbers of accounts.
    Shape("iam_names", "user-name", lead=r"\barn:aws[\w-]*:iam::[^:\s]*:user/", alphabet="path", edge="", needs=(":user/",)),
    Shape("iam_names", "session-name", lead=r":assumed-role/[\w+=,.@-]+/", alphabet="arn", edge="", needs=(":assumed-role/",)),
    Shape("iam_names", "session-name", lead=r"\bAROA[A-Z0-9]{16,}:", alphabet="arn", edge="", needs=("aroa",)),
    Shape("sso_hash", "role-hash", lead=r"\bAWSReservedSSO_[\w+=,.@-]+?_", alphabet="hex", least=16, most=16, tail="(?![0-9a-f])", edge="", needs=("awsreservedsso_",)),
    Shape("account_ids", "account", alphabet="digit", least=12, most=12, edge=r"\w.", needs="digits"),
    Shape("account_ids", "account", body=r"\d{4}-\d{4}-\d{4}", edge=r"\w.-", needs="digits"),
    Shape("org_ids", "organisation", body=r"o-(?=[a-z0-9]*\d)[a-z0-9]{10,32}", edge=r"\w-", needs=("o-",)),
    Shape("org_ids", "unit", body=r"ou-[a-z0-9]{4,32}-[a-z0-9]{8,32}", edge=r"\w-", needs=("ou-",)),
    Shape("org_ids", "root", body=r"r-(?=[a-z0-9]*\d)[a-z0-9]{4,32}", edge=r"\w-", needs=("r-",)),
    Shape("org_ids", "directory", body=r"d-(?=[0-9a-f]*\d)[0-9a-f]{10}", edge=r"\w-", needs=("d-",)),
    Shape("resource_ids", "resource", body=rf"(?:{'|'.join(RESOURCE_KINDS)})-(?=[0-9a-f]*\d)[0-9a-f]{{8,17}}", edge=r"\w-", needs="digits"),
    Shape("resource_ids", "resource", heads=("db-", "cluster-", "prx-"), alphabet="upper", least=20, edge=r"\w-", needs=("db-", "cluster-", "prx-")),
    Shape("uuids", "uuid", body=r"(?:[0-9a-f]{10}-)?[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", edge=r"\w-", needs=("-",)),
    Shape("canonical_ids", "canonical-id", alphabet="hex", least=64, most=64, edge=r"\w:", needs="long"),
    # Hosts whose first part is an identifier.
    Shape("aws_hostnames", "zone", body=r"Z(?=[A-Z0-9]*\d)[A-Z0-9]{9,31}", needs=("z",)),
    Shape("aws_hostnames", "distribution", body=r"E(?=[A-Z0-9]*\d)[A-Z0-9]{12,13}", needs="digits"),
    Shape("aws_hostnames", "host", alphabet="lower", least=10, most=10, tail=r"(?=\.execute-api\.)", edge="", needs=(".execute-api.",)),
    Shape("aws_hostnames", "host", alphabet="lower", tail=r"(?=\.cloudfront\.net\b)", edge="", needs=(".cloudfront.net",)),
    Shape("aws_hostnames", "host", body=r"(?:internal-)?[\w-]{1,62}-\d{1,20}", tail=rf"(?=\.{REGION}\.elb\.amazonaws\.com)", edge="", needs=(".elb.amazonaws.com",)),
    Shape("aws_hostnames", "host", alphabet="lower", least=20, tail=r"(?=\.lambda-url\.)", edge="", needs=(".lambda-url.",)),
    Shape("aws_hostnames", "host", body=r"[a-z0-9-]+", tail=r"(?=\.awsapps\.com\b)", edge="", needs=(".awsapps.com",)),
    Shape("aws_hostnames", "host", body=r"[a-z0-9-]+\.(?:cluster-(?:ro-)?)?[a-z0-9]{12}", tail=rf"(?=\.{REGION}\.rds\.amazonaws\.com)", edge="", needs=(".rds.amazonaws.com",)),
    Shape("buckets", "bucket", lead="(?:s3://|arn:aws:s3:::)", body=r"[a-z0-9][a-z0-9.-]{1,61}[a-z0-9]", edge="", needs=("s3://", ":s3:::")),
    Shape("buckets", "bucket", body=r"[a-z0-9][a-z0-9.-]{1,61}[a-z0-9]", tail=rf"(?=\.s3(?:[.-]{REGION})?\.amazonaws\.com)", edge="", needs=(".s3.", ".s3-")),
    # People and machines.
    Shape("emails", "email", body=r"[\w.%+-]{1,64}@[A-Za-z0-9.-]{1,253}\.[A-Za-z]{2,63}", needs=("@",), check="email"),
    Shape("ips", "ipv4", body=r"\d{1,3}(?:\.\d{1,3}){3}", tail=r"(?!\w|\.\d)", lead=r"(?<![\w.])", edge="", needs=(".",), check="ipv4"),
    Shape("ips", "ipv6", body=r"(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[0-9A-Fa-f:]*::)(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}", edge=r"\w:.", needs="six"),
    Shape("macs", "mac", body=r"(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}|(?:[0-9A-Fa-f]{2}-){5}[0-9A-Fa-f]{2}|(?:[0-9a-f]{4}\.){2}[0-9a-f]{4}", edge=r"\w:-", needs="mac"),
    Shape("phones", "phone", body=r"(?:\+?1[ .-]?)?(?:\(\d{3}\)|\d{3})[ .-]\d{3}[ .-]\d{4}", lead=r"(?<![\w+])", tail=r"(?![\w-])", edge="", needs="digits"),
    Shape("phones", "phone", body=r"\+\d{10,15}", edge=r"\w+", needs=("+",)),
    Shape("gov_ids", "social-security", body=r"\d{3}-\d{2}-\d{4}", edge=r"\w-", needs="digits"),
    Shape("cards", "card", body=r"[3-6]\d{3}(?:[ -]?\d{4}){3}|3[47]\d{2}[ -]?\d{6}[ -]?\d{5}", edge=r"\w-", needs="digits", check="luhn"),
    Shape("home_paths", "user-name", lead=r"(?:/home/|/Users/|[A-Za-z]:\\+Users\\+)", body=r"[^/\\\s\"':]+", edge="", needs=("/home/", "/users/", ":\\")),
)
CATEGORIES = tuple(dict.fromkeys(x.category for x in SHAPES))
ANSI = r"\x1b\[[0-9;?]*[ -/]*[@-~]"
FOUND = "array<struct<start:int,end:int,prio:int,cat:string,label:string>>"
CHOSEN = "struct<start:int,end:int,label:string>"


@dataclass(frozen=True)
class Options:
    enabled: tuple[str, ...] = CATEGORIES
    placeholder: str = "REDACTED"
    numbered: bool = False
    #: Words that are always covered, and words that stay visible when a span lies fully inside one.
    always: tuple[str, ...] = ()
    never: tuple[str, ...] = ()


def _quoted(words: tuple[str, ...]) -> str:
    return r"(?i)(?<!\w)(" + "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w))) + r")(?!\w)"


def check(kind: str | None, value: Column) -> Column:
    if kind == "long":
        return mixed(value) & (entropy(value) >= 4.8)
    if kind == "secret40":
        return mixed(value) & (entropy(value) >= 4.2)
    if kind == "url":
        return ~value.rlike(r"^[^:]*:\d{1,5}(?:[/?#]|$)")
    if kind == "email":
        return ~value.rlike(r"(?i)^git@|openssh\.com$")
    if kind == "ipv4":
        parts = F.split(value, r"\.")
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (p.try_cast("int") <= 255) & ~p.rlike(r"^0\d")) & ~value.rlike(r"^(?:0|255|127)\.")
    if kind == "luhn":
        return luhn(value)
    if kind == "value":
        return ~value.rlike(r"(?i)^(?:\$\{|\$\(|var\.|local\.|data\.|<|changeme|example|null|none|true|false|\*+$|x+$)")
    return F.lit(True)


def _shape_spans(text: Column, prio: int, shape: Shape, pattern: str | None = None) -> Column:
    """(start, end, prio, cat, label) of what one shape covers. Gaps, whole matches and covered parts come in one order,
    so a part's place follows from lengths; the part stands at the end of its match."""
    pattern = pattern or shape.pattern()

    def cut(gaps: Column, found: Column, parts: Column) -> Column:
        def step(at: Column, i: Column) -> Column:
            end = at + F.length(F.get(gaps, i)) + F.length(F.get(found, i))
            part = F.get(parts, i)
            one = F.struct((end - F.length(part)).alias("start"), end.alias("end"), F.lit(prio).alias("prio"), F.lit(shape.category).alias("cat"), F.lit(shape.label).alias("label"))
            return F.struct(end.alias("at"), F.when(check(shape.check, part), F.array(one)).otherwise(F.array().cast(FOUND)).alias("add"))

        return swept(F.sequence(F.lit(0), F.size(found) - 1), F.lit(0), step, FOUND[6:-1])

    every = lambda group: F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    return F.when(text.rlike(pattern), let(F.split(text, pattern), lambda g: let(every(0), lambda m: let(every(1), lambda v: cut(g, m, v))))).otherwise(F.array().cast(FOUND))


def likely(text: Column, options: Options = Options()) -> Column:
    """False only for texts in which ``find`` finds nothing: they have no word and pass no test that an enabled shape needs."""
    if options.always:
        return F.lit(True)
    needs = [x.needs for x in SHAPES if x.category in options.enabled]
    words = {w for n in needs if not isinstance(n, str) for w in n}
    least = sorted(w for w in words if not any(v != w and v in w for v in words))
    # One pass in either case: lower-case copies of texts beyond ASCII cost more than the search.
    out = text.rlike(rf"(?iu)(?=[{''.join(sorted({re.escape(w[0]) for w in least}))}])(?:{'|'.join(map(re.escape, least))})") if least else F.lit(False)
    for n in sorted({n for n in needs if isinstance(n, str)}):
        out = out | text.rlike(NEEDS[n])
    return out


def find(text: Column, options: Options = Options()) -> Column:
    """All spans of the enabled categories, overlapping ones included. A shape is tried only on texts that have one of the
    words that it needs, which are looked up in the lower-case text, or that pass the test it shares with others."""
    chosen = [(i, x) for i, x in enumerate(SHAPES) if x.category in options.enabled]
    nothing = F.array().cast(FOUND)

    def tried(low: Column, passed: Column) -> Column:
        def may(x: Shape) -> Column:
            if isinstance(x.needs, str):
                return passed[x.needs]
            words = [low.contains(w) for w in x.needs]
            out = words[0]
            for w in words[1:]:
                out = out | w
            return out

        parts = [F.when(may(x), _shape_spans(text, i, x)).otherwise(nothing) for i, x in chosen]
        if options.always:
            parts.append(_shape_spans(text, len(SHAPES), Shape("custom_words", "word"), _quoted(options.always)))
        return F.concat(nothing, *parts)

    tests = F.struct(*(text.rlike(p).alias(n) for n, p in NEEDS.items()))
    found = let(F.lower(text), lambda low: let(tests, lambda passed: tried(low, passed)))
    if options.never:
        shown = spans(text, _quoted(options.never))
        found = let(shown, lambda kept: F.filter(found, lambda s: ~F.exists(kept, lambda p: (p["start"] <= s["start"]) & (s["end"] <= p["end"]))))
    return found


def resolve(found: Column) -> Column:
    """Earliest start, then longest, then first rule; what overlaps a chosen span goes."""
    order = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["prio"].alias("prio"), s["label"].alias("label"))))

    def step(at: Column, s: Column) -> Column:
        free = s["start"] >= at
        one = F.array(F.struct(s["start"].alias("start"), (-s["back"]).alias("end"), s["label"].alias("label")))
        return F.struct(F.when(free, -s["back"]).otherwise(at).alias("at"), F.when(free, one).otherwise(F.array().cast(f"array<{CHOSEN}>")).alias("add"))

    return swept(order, F.lit(0), step, CHOSEN)


def cover(text: Column, chosen: Column, options: Options = Options()) -> Column:
    """The text with placeholders; numbered ones repeat for equal values of a label, case-blind."""

    def pieces(at: Callable[[Column, Column], Column]) -> Column:
        value = lambda s: F.concat_ws("\u0001", s["label"], F.lower(at(s["start"], s["end"])))

        def with_keys(keys: Column, values: Column) -> Column:
            def placeholder(s: Column, v: Column) -> Column:
                if not options.numbered:
                    return F.lit(f"[{options.placeholder}]")
                own = F.filter(keys, lambda k: F.substring_index(k, "\u0001", 1) == s["label"])
                return F.concat(F.lit(f"[{options.placeholder}-"), s["label"], F.lit("-"), F.array_position(own, v).cast("string"), F.lit("]"))

            left = F.concat(F.array(F.lit(0)), F.transform(chosen, lambda s: s["end"]))
            right = F.concat(F.transform(chosen, lambda s: s["start"]), F.array(F.length(text)))
            gaps = F.zip_with(left, right, at)
            marks = F.concat(F.zip_with(chosen, values, placeholder), F.array(F.lit("")))
            return F.array_join(F.zip_with(gaps, marks, lambda g, m: F.concat(g, m)), "")

        if not options.numbered:
            return with_keys(F.array().cast("array<string>"), F.transform(chosen, lambda s: s["label"]))
        return let(F.transform(chosen, value), lambda values: let(F.array_distinct(values), lambda keys: with_keys(keys, values)))

    return between(text, chosen, pieces)


def redact(docs: DataFrame, text: str = "text", options: Options = Options()) -> DataFrame:
    """Adds ``spans`` (start, end, label) and ``redacted``."""
    plain = docs.withColumn("_plain", F.regexp_replace(F.coalesce(F.col(text), F.lit("")), ANSI, ""))
    found = plain.withColumn("spans", resolve(find(F.col("_plain"), options)))
    return found.withColumn("redacted", F.when(F.size("spans") > 0, cover(F.col("_plain"), F.col("spans"), options)).otherwise(F.col("_plain"))).drop("_plain")


def counts(redacted: DataFrame) -> DataFrame:
    return redacted.select(F.explode("spans").alias("s")).groupBy(F.col("s.label").alias("label")).agg(F.count("*").alias("hits"))


# Queries and their SQL


def _docs(spark, sf_dir, table="documents"):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


KEY = b"stratalog demo key"
_KEYHEX = lambda x: bytes(b ^ x for b in KEY.ljust(64, b"\0")).hex()


def _checks(spark, sf_dir):
    d = _docs(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lpad((F.col("c_custkey") * 7919 + 4000).cast("string"), 16, "4")).alias("n"), F.col("c_name").alias("s"))
    return d.select("c_custkey", luhn(F.col("n")).alias("luhn"), F.round(entropy(F.col("s")), 6).alias("entropy"), mixed(F.col("s")).alias("mixed"))


QUERIES = {
    "redact_find": lambda spark, sf_dir: _docs(spark, sf_dir).select("doc_id", F.explode(find(F.coalesce("text", F.lit("")))).alias("s")).select("doc_id", "s.start", "s.end", "s.cat", "s.label"),
    "redact_resolve": lambda spark, sf_dir: redact(_docs(spark, sf_dir)).select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.*"),
    "redact_apply": lambda spark, sf_dir: redact(_docs(spark, sf_dir, "conversations"), options=Options(numbered=True)).select("conv_id", "turn", "redacted"),
    "redact_counts": lambda spark, sf_dir: counts(redact(_docs(spark, sf_dir))),
    "redact_key_values": lambda spark, sf_dir: _docs(spark, sf_dir).select("doc_id", "text", F.explode(find(F.coalesce("text", F.lit("")), Options(enabled=("secret_values",)))).alias("s")).select("doc_id", "s.start", "s.end", F.substring(F.col("text"), F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("v")).distinct().groupBy("doc_id", F.sha2("v", 256).alias("value_sha256")).agg(F.count("*").alias("hits")),
    "redact_never": lambda spark, sf_dir: redact(_docs(spark, sf_dir), options=Options(enabled=(), always=("the", "and"), never=("and the",))).select("doc_id", F.size("spans").cast("bigint").alias("hits")),
    "redact_ansi": lambda spark, sf_dir: _docs(spark, sf_dir).select("doc_id", F.length(F.regexp_replace(F.concat(F.lit("\x1b[31m"), F.coalesce("text", F.lit("")), F.lit("\x1b[0m")), ANSI, "")).cast("bigint").alias("n")),
    "redact_pseudonym": lambda spark, sf_dir: _docs(spark, sf_dir, "customer").select("c_custkey", pseudonym(F.col("c_name"), KEY).alias("pseudonym")),
    "redact_checks": _checks,
    "secrets_mask": lambda spark, sf_dir: _docs(spark, sf_dir, "customer").select("c_custkey", masked(F.col("c_name")).alias("masked")),
    "src_text_lines": lambda spark, sf_dir: _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "line")).select("doc_id", (F.col("i") + 1).cast("bigint").alias("line_no"), F.length("line").cast("bigint").alias("n_chars")),
}
ORACLES = {
    "redact_key_values": r"""WITH d AS (SELECT doc_id, text, unnest(regexp_extract_all(text, '(?i)(?:api_key|apikey|credential|passphrase|passwd|password|private_key|privatekey|secret|token)s?["'']?[ \t]*[:=][ \t]*(?:"[^"\n]+|''[^''\n]+|[^\s"''&{\[(][^\s"''&]{5,})')) AS m FROM documents), n AS (SELECT *, regexp_extract(m, '^([^:=]*[:=][ \t]*["'']?)', 1) AS pre FROM d)
SELECT doc_id, sha256(substr(m, length(pre) + 1)) AS value_sha256, count(*) AS hits FROM n WHERE NOT regexp_matches(substr(m, length(pre) + 1), '(?i)^(?:\$\{|\$\(|var\.|local\.|data\.|<|changeme|example|null|none|true|false|\*+$|x+$)') GROUP BY ALL""",
    "redact_never": r"""SELECT doc_id, CAST(len(regexp_extract_all(x, '(?i)\b(?:the|and)\b')) AS BIGINT) AS hits FROM (SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '(?i)\band the\b', '#', 'g'), '[^\x00-\x7f]', 'w', 'g') AS x FROM documents)""",
    "redact_ansi": "SELECT doc_id, length(coalesce(text, '')) AS n FROM documents",
    "redact_pseudonym": f"SELECT c_custkey, 'c' || sha256(unhex('{_KEYHEX(0x5C)}') || unhex(sha256(unhex('{_KEYHEX(0x36)}') || encode(c_name))))[1:24] AS pseudonym FROM customer",
    "redact_checks": r"""WITH d AS (SELECT c_custkey, lpad(CAST(c_custkey * 7919 + 4000 AS VARCHAR), 16, '4') AS n, c_name AS s FROM customer),
x AS (SELECT *, list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 1 THEN (2 * CAST(n[i] AS INT)) // 10 + (2 * CAST(n[i] AS INT)) % 10 ELSE CAST(n[i] AS INT) END)) AS total FROM d)
SELECT c_custkey, total % 10 = 0 AND NOT regexp_full_match(n, '4+') AS luhn, round(list_sum(list_transform(list_distinct(string_split(s, '')), lambda c: -((length(s) - length(replace(s, c, ''))) / length(s)) * log2((length(s) - length(replace(s, c, ''))) / length(s)))), 6) AS entropy, regexp_matches(s, '[A-Z]') AND regexp_matches(s, '[a-z]') AND regexp_matches(s, '[0-9]') AS mixed FROM x""",
    "secrets_mask": "SELECT c_custkey, CASE WHEN length(c_name) <= 8 THEN '****' ELSE left(c_name, 4) || '****' || right(c_name, 4) END AS masked FROM customer",
    "src_text_lines": "SELECT doc_id, i AS line_no, length(l[i]) AS n_chars FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))",
}
