"""Stable identities: canonical keys, their serialization and digest, and the rules a key must keep, all as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEMA = "cm1"
#: Kinds by what they may do.
CALLABLE = ("function", "method", "constructor", "destructor", "conversion_function", "operator_function", "lambda")
OWNERS = ("namespace", "class", "struct", "union", "enum", "anonymous_type", *CALLABLE)
LOCAL_ONLY = ("lambda", "anonymous_type", "local_variable")


def field(tag: str, value: Column) -> Column:
    """tag=<byte length>:<value>;"""
    return F.concat(F.lit(f"{tag}="), F.octet_length(value).cast("string"), F.lit(":"), value, F.lit(";"))


def _template(prefix: str, role: Column, parameters: Column, arguments: Column) -> Column:
    shown = F.concat(field(f"{prefix}trole", role), field(f"{prefix}tparams", parameters), field(f"{prefix}targs", arguments))
    return F.when(role == "none", F.lit("")).otherwise(shown)


def serialize(key: Column) -> Column:
    """key: struct(member, language, kind, owners, name, signature, template_role, template_parameters, template_arguments, linkage).

    owners: array of struct(kind, name, signature, template_role, template_parameters, template_arguments);
    linkage: struct(type, file, enclosing, anchor, ordinal).
    """

    def owner(o: Column) -> Column:
        return F.concat(field("okind", o["kind"]), field("oname", o["name"]), field("osig", o["signature"]), _template("o", o["template_role"], o["template_parameters"], o["template_arguments"]))

    link = key["linkage"]
    scoped = (
        F.when(link["type"] == "internal", field("file", link["file"]))
        .when(link["type"] == "local", F.concat(field("enclosing", link["enclosing"]), field("anchor", link["anchor"]), field("ordinal", link["ordinal"].cast("string"))))
        .otherwise("")
    )
    return F.concat(
        F.lit(f"{SCHEMA}|"), field("member", key["member"]), field("lang", key["language"]), field("kind", key["kind"]), field("owners", F.size(key["owners"]).cast("string")),
        F.array_join(F.transform(key["owners"], owner), ""), field("name", key["name"]), field("sig", key["signature"]),
        _template("", key["template_role"], key["template_parameters"], key["template_arguments"]), field("linkage", link["type"]), scoped,
    )


def scope_file(serialized: Column) -> Column:
    """The file that a symbol of internal linkage belongs to; null for others."""
    found = F.regexp_extract(serialized, r"linkage=8:internal;file=\d+:(.*);$", 1)
    return F.when(found != "", found)


def enclosing(serialized: Column) -> Column:
    """The stable id of the symbol around a local one; null for others."""
    found = F.regexp_extract(serialized, rf"linkage=5:local;enclosing=\d+:({SCHEMA}:[0-9a-f]{{32}});anchor=", 1)
    return F.when(found != "", found)


def stable_id(serialized: Column) -> Column:
    return F.concat(F.lit(f"{SCHEMA}:"), F.substring(F.sha2(serialized.cast("binary"), 256), 1, 32))


def is_stable_id(c: Column) -> Column:
    return c.rlike(f"^{SCHEMA}:[0-9a-f]{{32}}$")


def is_repo_path(path: Column) -> Column:
    """Relative, with forward slashes, without empty, '.' or '..' parts."""
    parts = F.split(path, "/")
    return (path != "") & ~path.rlike(r"^[A-Za-z]:|\\") & ~F.exists(parts, lambda p: p.isin("", ".", ".."))


def problem(key: Column) -> Column:
    """The first rule that a key breaks, or null."""

    def templated(x: Column, what: str) -> Column:
        role, par, arg = x["template_role"], x["template_parameters"], x["template_arguments"]
        special, listed = role.isin("explicit_specialization", "partial_specialization"), role.isin("primary", "partial_specialization")
        return (
            F.when(special & (arg == ""), F.lit(f"{what}: a specialization needs arguments"))
            .when(~special & (arg != ""), F.lit(f"{what}: arguments without a specialization"))
            .when(listed & (par == ""), F.lit(f"{what}: a primary or partial template needs parameters"))
            .when(~listed & (par != ""), F.lit(f"{what}: parameters without a template"))
        )

    def signed(kind: Column, sig: Column, what: str) -> Column:
        return F.when(kind.isin(*CALLABLE) & (sig == ""), F.lit(f"{what}: a callable needs a signature")).when(~kind.isin(*CALLABLE) & (sig != ""), F.lit(f"{what}: a signature without a callable"))

    def owner(o: Column) -> Column:
        unnamed = (o["name"] == "") & ~o["kind"].isin("namespace", "lambda", "anonymous_type")
        return F.coalesce(F.when(~o["kind"].isin(*OWNERS), F.lit("owner: the kind cannot own")), signed(o["kind"], o["signature"], "owner"), F.when(unnamed, F.lit("owner: must be named")))

    owners, link, kind = key["owners"], key["linkage"], key["kind"]
    first = lambda a: F.get(F.filter(a, lambda x: x.isNotNull()), F.lit(0))
    anonymous = F.exists(owners, lambda o: (o["name"] == "") & (o["kind"] == "namespace"))
    unnamed_ok = kind.isin("lambda", "anonymous_type") | ((kind == "namespace") & (link["type"] == "internal"))
    declared = (kind == "anonymous_type") | ((kind == "lambda") & (link["anchor"] == "lambda-decl-init"))
    local_only = F.when(kind.isin(*LOCAL_ONLY), F.lit("must use a local scope"))
    return F.coalesce(
        F.when(key["member"] == "", F.lit("the member is empty")),
        F.when(key["member"].rlike(r"^[/\\]|^[A-Za-z]:"), F.lit("the member is an absolute path")),
        templated(key, "symbol"),
        first(F.transform(owners, lambda o: templated(o, "owner"))),
        signed(kind, key["signature"], "symbol"),
        F.when((key["name"] == "") & ~unnamed_ok, F.lit("the name is empty")),
        first(F.transform(owners, owner)),
        F.when((kind == "namespace") & (key["name"] != "") & ~anonymous & (link["type"] != "external"), F.lit("a named namespace has external linkage")),
        F.when(link["type"] == "internal", F.coalesce(local_only, F.when(F.coalesce(link["file"], F.lit("")) == "", F.lit("internal linkage needs a file")), F.when(~is_repo_path(link["file"]), F.lit("the file is not a repository path")))),
        F.when(
            link["type"] == "local",
            F.coalesce(
                F.when(kind == "namespace", F.lit("a namespace cannot be local")),
                F.when((F.size(owners) == 0) & ~declared, F.lit("a local needs an owner")),
                F.when(~is_stable_id(F.coalesce(link["enclosing"], F.lit(""))), F.lit("a local needs an enclosing id")),
                F.when(F.coalesce(link["anchor"], F.lit("")) == "", F.lit("a local needs an anchor")),
            ),
        ),
        F.when(link["type"] == "external", F.coalesce(local_only, F.when(anonymous, F.lit("members of an anonymous namespace are internal")))),
    )
