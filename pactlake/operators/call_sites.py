"""Places in calling source code that a contract change reaches.

Files become tables of facts once (`pactlake.sources.source_code`); everything after that is joins. Calls meet the declared
request functions by name and take their URL, method and payload from the arguments these name; payloads are the object
literals at those arguments, with their own properties. Calls meet changes by an equi-join on the length and first segment of
the URL's suffix, never by comparing every call with every change. A response is followed from the call that returns it
through decoding to the variable that holds it, and to the type that this variable is declared, cast or returned as: a declared
type carries a rename to every reader of it in the repository, a bare variable to its own reads alone.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactlake.functions import urls
from pactlake.functions.text import leaf_of, snake_case, snippet
from pactlake.operators.edits import dedupe_sites
from pactlake.sources.source_code import syntax
from pactlake.work import discard, written

#: Members that make a request, those of them that send their second argument, and methods that a call may name.
MEMBERS = ("get", "post", "put", "patch", "delete", "head", "options", "request")
SENDING = ("post", "put", "patch")
METHODS = ("get", "put", "post", "delete", "options", "head", "patch", "trace")
#: A parameter of a template, as a key of the join.
ANY = "{}"
#: Rounds in which a variable takes the type of the variable it is set to.
ALIAS_ROUNDS = 3
HERE = ["repo", "file"]
#: Files that a Python worker holds at a time.
BATCH_FILES = 256
#: Tasks of the scan for each core of the session, at least.
TASKS_A_CORE = 4


@dataclass(frozen=True)
class Wrapper:
    """A function that makes requests; arguments count from 0. `repo`: null for all repositories."""

    name: str
    url_argument: int = 0
    body_argument: int | None = None
    method_argument: int | None = None
    repo: str | None = None


WRAPPERS = "repo string, name string, url_argument int, body_argument int, method_argument int"


def wrapper_table(spark, wrappers: Iterable[Wrapper | str]) -> DataFrame:
    found = [Wrapper(w) if isinstance(w, str) else w for w in wrappers]
    return spark.createDataFrame([(w.repo, w.name, w.url_argument, w.body_argument, w.method_argument) for w in found], WRAPPERS)


def spread(files: DataFrame) -> DataFrame:
    """`files` dealt out by name: reading them costs far more than their bytes, by which Spark cuts a small table into a task or two."""
    spark = files.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), TASKS_A_CORE * spark.sparkContext.defaultParallelism)
    return files.repartition(n, "repo", "file")


class Code:
    """The facts of files (repo, file, content), written once by kind; `close` removes them."""

    def __init__(self, files: DataFrame) -> None:
        self.spark = files.sparkSession
        self.facts, path = written(syntax(spread(files)), "code-facts", by="kind", batch=BATCH_FILES)
        self._paths = [path]

    def of(self, kind: str, **names: str) -> DataFrame:
        """repo, file and the columns named, each under its new name."""
        return self.facts.filter(F.col("kind") == kind).select("repo", "file", *[F.col(c).alias(n) for c, n in names.items()])

    def keep(self, df: DataFrame, tag: str) -> DataFrame:
        out, path = written(df, tag)
        self._paths.append(path)
        return out

    def close(self) -> None:
        discard(self.spark, *self._paths)
        self._paths = []


def _argument(i: Column | int) -> Column:
    return F.try_element_at("arguments", (i + 1 if isinstance(i, Column) else F.lit(i + 1)).cast("int"))


def _member(members: Column | str, name: str) -> Column:
    """The value that an object literal gives a property, null without it."""
    return F.try_element_at(F.filter(members, lambda m: (m["name"] == name) & ~m["short"]), F.lit(1))["value"]


def _method(text: Column) -> Column:
    lower = F.lower(text)
    return F.when(lower.isin(*METHODS), lower)


def http_calls(code: Code, wrappers: DataFrame | None = None, base_urls: DataFrame | None = None) -> DataFrame:
    """One row for each request of the code: call (its id), url (HOLE for computed parts), where and how that is written,
    method (null: not known), payload (the object literal it sends, null: none), ref (the declaration that receives the answer).

    Requests are `fetch`, `x.<method>`, functions of one object with a `url`, and the functions of `wrappers` (columns of WRAPPERS),
    which come before all others. base_urls: repo (null: all), base_url, which is left out of URLs that begin with it.
    """
    calls = code.of("call", id="call", name="callee", text="last", arguments="arguments", ref="ref", type="argument_type")
    if wrappers is None:
        wrappers = wrapper_table(code.spark, ())
    # A repository's own rule comes before one for all.
    rule = F.min_by(F.struct("url_argument", "body_argument", "method_argument"), F.struct("url_argument", "body_argument", "method_argument")).alias("rule")
    own = wrappers.filter("repo IS NOT NULL").groupBy("repo", F.col("name").alias("callee")).agg(rule).withColumnRenamed("rule", "_own")
    general = wrappers.filter("repo IS NULL").groupBy(F.col("name").alias("callee")).agg(rule).withColumnRenamed("rule", "_all")
    c = calls.join(own, ["repo", "callee"], "left").join(general, "callee", "left").withColumn("_rule", F.coalesce("_own", "_all"))
    c = c.select(*calls.columns, "_rule.url_argument", "_rule.body_argument", "_rule.method_argument")
    ruled = F.coalesce(F.col("url_argument") < F.size("arguments"), F.lit(False))
    fetch = F.col("callee") == "fetch"
    member = F.col("callee").contains(".") & F.col("last").isin(*MEMBERS)
    sends = F.col("last").isin(*SENDING)
    one = F.col("_first.object").isNotNull() & ~ruled
    options = F.when(one, F.col("_first.object")).when(fetch, _argument(1)["object"]).when(member, F.when(sends, _argument(2)["object"]).otherwise(_argument(1)["object"]))
    c = c.withColumn("_first", _argument(0)).withColumns({"_ruled": ruled, "_options": F.when(~ruled, options)})
    # Calls that can't be requests go before their options are looked up.
    c = c.filter(F.col("_ruled") | one | ((fetch | member) & F.col("_first.url").isNotNull()))
    literals = code.of("object", id="_options", members="_members")
    c = c.join(literals, [*HERE, "_options"], "left")
    stated = _method(_member("_members", "method")["literal"])
    alone = ~F.col("_ruled") & one & _member("_members", "url").isNotNull()
    url = F.when(F.col("_ruled"), _argument(F.col("url_argument"))).when(alone, _member("_members", "url")).when(fetch | member, F.col("_first"))
    method = F.when(F.col("_ruled"), _method(_argument(F.col("method_argument"))["literal"])).when(alone, stated).when(fetch, F.coalesce(stated, F.lit("get"))).otherwise(F.coalesce(_method(F.col("last")), stated))
    body = F.when(F.col("_ruled"), _argument(F.col("body_argument"))["object"]).when(alone, F.coalesce(_member("_members", "data"), _member("_members", "body"))["object"])
    body = body.when(fetch, _member("_members", "body")["object"]).when(sends, _argument(1)["object"])
    c = c.withColumns({"_url": url, "method": method, "payload": body}).filter("_url.url IS NOT NULL")
    text = F.col("_url.url")
    if base_urls is not None:
        b = base_urls.select(F.col("repo").alias("b_repo"), "base_url")
        text = F.when(F.length("base_url") > 0, F.when(F.startswith("_url.url", F.col("base_url")), F.substr("_url.url", F.length("base_url") + 1))).otherwise(F.lit(None))
        text = F.coalesce(text, F.col("_url.url"))
        c = c.join(b, F.col("b_repo").isNull() | (F.col("b_repo") == F.col("repo")), "left")
    return c.select("repo", "file", "call", "callee", "last", text.alias("url"), F.col("_url.text").alias("url_text"), F.col("_url.at").alias("start_at"), F.col("_url.end_at").alias("end_at"), F.col("_url.line").alias("line"), "method", "payload", "ref", "argument_type")


def match_calls(calls: DataFrame, changes: DataFrame) -> DataFrame:
    """Calls joined to the changes whose path template ends their URL and whose method they may have.

    Where changes have a column `repo`, they meet the calls of that repository alone.
    """
    have = urls.segments(urls.strip_origin(urls.path_portion("url")))
    n = F.size(have)
    keyed = calls.withColumn("_have", have).withColumn("_n", F.explode(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))))
    first = F.element_at("_have", F.size("_have") - F.col("_n") + 1)
    keyed = keyed.withColumn("_first", F.explode(F.array(first, F.lit(ANY)))).drop("_have")
    want = urls.segments("path")
    lead = F.element_at(want, 1)
    own = [c for c in ("repo",) if c in changes.columns]
    detail = F.col("detail") if "detail" in changes.columns else F.lit(None).cast("string")
    ch = changes.filter(F.size(want) > 0).select(*own, F.col("id").alias("change_id"), "kind", "direction", "path", "operation_id", "from_name", "to_name", detail.alias("detail"), F.col("method").alias("op_method"), F.size(want).alias("_n"), F.when(urls.is_template(lead), F.lit(ANY)).otherwise(lead).alias("_first"))
    fits = urls.matches_template("url", "path") & (F.col("method").isNull() | F.col("op_method").isNull() | (F.col("method") == F.col("op_method")))
    return keyed.join(ch, [*own, "_n", "_first"]).filter(fits).drop("_n", "_first")


SITE = ("repo", "file", "change_id", "start_at", "end_at", "line", "text", "replacement", "codemod", "strategy", "confidence", "reason", "snippet")


def _site(df: DataFrame, strategy: Column | str, reason: Column, replacement: Column | None = None, codemod: str | None = None, confidence: Column | str = "high") -> DataFrame:
    """Sites of rows with repo, file, change_id, start_at, end_at, line and text."""
    new = replacement if replacement is not None else F.lit(None).cast("string")
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return df.withColumns({"replacement": new, "codemod": F.when(new.isNotNull(), F.lit(codemod)), "strategy": as_col(strategy), "confidence": as_col(confidence), "reason": reason, "snippet": snippet("text")}).select(*SITE)


def _how(df_url: str = "url") -> Column:
    return F.when(F.col(df_url).contains(urls.HOLE), "url.template").otherwise("url.literal")


def _renamed_paths(hits: DataFrame) -> DataFrame:
    hits = hits.filter("kind = 'path.renamed'").withColumn("text", F.col("url_text"))
    return _site(hits, _how(), F.concat_ws(" ", F.lit("path"), "path", F.lit("is now"), "to_name"), urls.rewrite_path("text", "path", "to_name"), "rename-path")


def _renamed_request_fields(code: Code, hits: DataFrame) -> DataFrame:
    """The property of the payload that has the old name; a shorthand property keeps its variable."""
    h = hits.filter("kind = 'request.field.renamed' AND payload IS NOT NULL").withColumns({"_from": leaf_of("from_name"), "_to": leaf_of("to_name")}).filter("_from IS NOT NULL AND _to IS NOT NULL")
    h = h.drop("start_at", "end_at", "line").join(code.of("object", id="payload", members="members"), [*HERE, "payload"])
    h = h.withColumn("_p", F.explode("members")).filter("_p.name = _from")
    h = h.withColumns({"start_at": F.col("_p.at"), "end_at": F.col("_p.end_at"), "line": F.col("_p.line"), "text": F.col("_p.label")})
    quote = F.when(F.col("text").rlike("^['\"]"), F.substring("text", 1, 1)).otherwise(F.lit(""))
    new = F.when(F.col("_p.short"), F.concat("_to", F.lit(": "), "_from")).otherwise(F.concat(quote, "_to", quote))
    return _site(h, "request.payload", F.concat_ws(" ", F.lit("sends"), "_from", F.lit("which is now"), "_to"), new, "rename-request-field")


class Bindings:
    """Which declaration every variable means, which type it has, and where types are declared."""

    def __init__(self, code: Code) -> None:
        self.code = code
        # Patterns share the id of their brace.
        self.declared = code.keep(code.of("declare", id="id", name="name", type="type", scope="scope", scope_end="scope_end", text="alias", ref="alias_at", cast="taken"), "code-declared")
        self.types = code.of("type", name="type", id="type_id", fields="fields")
        self.functions = code.of("function", name="last", type="returns")
        self.typed = code.keep(self._typed(), "code-typed")

    def meant(self, uses: DataFrame, name: str, at: str) -> DataFrame:
        """`uses` with `id`: the innermost declaration of variable `name` around the offset `at`; uses without one go."""
        d = self.declared.select("repo", "file", F.col("name").alias(name), "id", "scope", "scope_end", "taken")
        met = uses.join(d, [*HERE, name]).filter((F.col("scope") <= F.col(at)) & (F.col(at) < F.col("scope_end")))
        inner = Window.partitionBy(*HERE, name, at).orderBy(F.desc("scope"), F.desc("id"))
        return met.withColumn("_r", F.dense_rank().over(inner)).filter("_r = 1").drop("_r", "scope", "scope_end")

    def located(self, named: DataFrame) -> DataFrame:
        """`named` (repo, file, type, ...) with type_file and type_id: the type of that name in the file, else the only one in
        the repository; rows without such a type go."""
        here = self.types.select("repo", F.col("file").alias("type_file"), "type", "type_id")
        own = named.join(here, (named["repo"] == here["repo"]) & (named["file"] == here["type_file"]) & (named["type"] == here["type"])).select(named["*"], "type_file", "type_id")
        alone = here.groupBy("repo", "type").agg(F.count("*").alias("n"), F.min("type_file").alias("type_file"), F.min("type_id").alias("type_id")).filter("n = 1").drop("n")
        local = here.select("repo", F.col("type_file").alias("file"), "type").distinct()
        return own.unionByName(named.join(local, ["repo", "file", "type"], "left_anti").join(alone, ["repo", "type"]).select(*named.columns, "type_file", "type_id"))

    def made_by(self, named: DataFrame) -> DataFrame:
        """`named` (repo, file, last, ...) with `returns`: the return type of that function in the file, else of the only one in
        the repository, and function_file."""
        f = self.functions.filter("last IS NOT NULL")
        near = f.groupBy("repo", "file", "last").agg(F.count("*").alias("n"), F.min("returns").alias("returns"))
        far = f.groupBy("repo", "last").agg(F.count("*").alias("n"), F.min("returns").alias("returns"), F.min("file").alias("function_file"))
        own = named.join(near.filter("n = 1").drop("n"), ["repo", "file", "last"]).withColumn("function_file", F.col("file"))
        rest = named.join(near.select("repo", "file", "last"), ["repo", "file", "last"], "left_anti").join(far.filter("n = 1").drop("n"), ["repo", "last"])
        return own.unionByName(rest).filter("returns IS NOT NULL")

    def _typed(self) -> DataFrame:
        """repo, file, id, type_file, type_id of declarations whose type is declared in the repository."""
        stated = self.located(self.declared.filter("type IS NOT NULL AND taken IS NULL").select("repo", "file", "id", "type"))
        makers = self.code.of("maker", id="id", text="last").join(self.declared.filter("type IS NOT NULL").select("repo", "file", "id"), [*HERE, "id"], "left_anti")
        made = self.made_by(makers).select("repo", F.col("file").alias("used"), "id", F.col("function_file").alias("file"), F.col("returns").alias("type"))
        made = self.located(made).select("repo", F.col("used").alias("file"), "id", "type_file", "type_id")
        known = stated.select("repo", "file", "id", "type_file", "type_id").unionByName(made).distinct()
        # A variable set to another one has its type; each round follows one more step.
        alias = self.declared.filter("alias IS NOT NULL AND type IS NULL").select("repo", "file", F.col("id").alias("own"), "alias", "alias_at")
        steps = self.meant(alias, "alias", "alias_at").select("repo", "file", "own", "id").filter("own <> id")
        for _ in range(ALIAS_ROUNDS):
            more = steps.join(known, [*HERE, "id"]).select("repo", "file", F.col("own").alias("id"), "type_file", "type_id")
            known = known.unionByName(more).distinct()
        return known

    def payloads(self, hits: DataFrame) -> DataFrame:
        """Of response hits (repo, file, call, ref, last, callee, argument_type): with var (a declaration that holds the payload or
        response, null: none) and type_file, type_id (its declared type, null: none)."""
        slim = hits.select("repo", "file", "call", "ref", "last", "callee", "argument_type").distinct()
        calls = self.code.of("call", name="_c", id="decode", at="decode_at", ref="decoded", cast="cast")
        decodes = calls.filter("_c RLIKE '^[A-Za-z_$][A-Za-z0-9_$]*[.]json$'").withColumn("var_name", F.substring_index("_c", ".", 1))
        decodes = self.meant(decodes, "var_name", "decode_at").select("repo", "file", F.col("id").alias("ref"), "decoded", "cast")
        none = F.lit(None).cast("int")
        direct = slim.filter("ref IS NOT NULL")
        through = direct.join(decodes, [*HERE, "ref"])
        held = through.filter("decoded IS NOT NULL").select("repo", "file", "call", F.col("decoded").alias("var"))
        taken = direct.join(self.declared.filter("taken = 'data'").select("repo", "file", F.col("id").alias("ref")), [*HERE, "ref"]).select("repo", "file", "call", F.col("ref").alias("var"))
        plain = direct.join(held.unionByName(through.filter("decoded IS NULL AND cast IS NOT NULL").select("repo", "file", "call", none.alias("var"))).unionByName(taken).select(*HERE, "call"), [*HERE, "call"], "left_anti").select("repo", "file", "call", F.col("ref").alias("var"))
        variables = held.unionByName(taken).unionByName(plain).distinct()
        variables = variables.join(self.typed.withColumnRenamed("id", "var"), [*HERE, "var"], "left")
        # Without a variable: the cast of a decoded answer, the type argument, the wrapper's type, or that of the function that
        # returns it. What the platform's own functions return is no payload.
        cast = through.filter("decoded IS NULL AND cast IS NOT NULL").select("repo", "file", "call", F.col("cast").alias("type"))
        bare = slim.filter("ref IS NULL AND callee <> 'fetch' AND NOT callee LIKE 'axios%'")
        stated = bare.filter("argument_type IS NOT NULL").select("repo", "file", "call", F.col("argument_type").alias("type"))
        bare = bare.filter("argument_type IS NULL")
        returned = bare.join(self.code.of("returned", id="call", type="type"), [*HERE, "call"]).select("repo", "file", "call", "type")
        made = self.made_by(bare.select("repo", "file", "call", "last")).select("repo", F.col("file").alias("used"), "call", F.col("function_file").alias("file"), F.col("returns").alias("type"))
        made = self.located(made).select("repo", F.col("used").alias("file"), "call", "type_file", "type_id")
        types = self.located(cast.unionByName(stated).unionByName(returned)).select("repo", "file", "call", "type_file", "type_id").unionByName(made).distinct()
        return variables.select("repo", "file", "call", "var", "type_file", "type_id").unionByName(types.select("repo", "file", "call", none.alias("var"), "type_file", "type_id"))


def _response_sites(code: Code, hits: DataFrame) -> DataFrame:
    """Types' properties and reads of fields that changed; renamed ones are rewritten, in every file of a declared type."""
    renamed = F.col("kind") == "response.field.renamed"
    h = hits.filter("direction = 'response' AND kind <> 'path.renamed'").withColumn("field", leaf_of(F.when(renamed, F.col("from_name")).otherwise(F.coalesce("from_name", "to_name"))))
    h = h.withColumn("_to", F.when(renamed, leaf_of("to_name"))).filter("field IS NOT NULL AND (kind <> 'response.field.renamed' OR _to IS NOT NULL)")
    h = code.keep(h.select("repo", "file", "call", "ref", "last", "callee", "argument_type", "change_id", "field", "_to", "detail").distinct(), "code-responses")
    scope = Bindings(code)
    held = h.join(scope.payloads(h), [*HERE, "call"])
    fields = scope.types.select("repo", F.col("file").alias("type_file"), "type_id", F.explode("fields").alias("f")).select("repo", "type_file", "type_id", F.col("f.name").alias("field"), F.col("f.at").alias("start_at"), F.col("f.end_at").alias("end_at"), F.col("f.line").alias("line"))
    held = code.keep(held.join(fields, ["repo", "type_file", "type_id", "field"], "left"), "code-held")
    typed = held.filter("start_at IS NOT NULL")
    reason = F.coalesce(F.concat_ws(" ", F.lit("reads"), "field", F.when(F.col("_to").isNotNull(), F.concat(F.lit("which is now "), "_to"))), F.lit(""))
    why = F.when(F.col("_to").isNotNull(), reason).otherwise(F.coalesce("detail", F.concat(F.lit("reads "), "field")))
    own = typed.select("repo", F.col("type_file").alias("file"), "change_id", "start_at", "end_at", "line", F.col("field").alias("text"), "field", "_to", "detail").distinct()
    out = _site(own, "response.type", why, F.col("_to"), "rename-response-field")
    # Reads of these names, with the declarations of their variables.
    wanted = h.select("repo", F.col("field").alias("name")).distinct()
    reads = code.of("member", name="name", text="base", ref="base_at", at="start_at", end_at="end_at", line="line", depth="depth").join(wanted, ["repo", "name"], "left_semi")
    reads = code.keep(scope.meant(reads, "base", "base_at").select("repo", "file", "id", F.col("name").alias("field"), "start_at", "end_at", "line", "depth", "taken", F.col("name").alias("text")), "code-reads")
    through = reads.filter("depth = 1 AND taken IS NULL").join(scope.typed, [*HERE, "id"])
    through = through.join(typed.filter("_to IS NOT NULL").select("repo", "type_file", "type_id", "field", "change_id", "_to", "detail").distinct(), ["repo", "type_file", "type_id", "field"])
    out = out.unionByName(_site(through, "response.member", why, F.col("_to"), "rename-response-field"))
    local = held.filter("start_at IS NULL AND var IS NOT NULL").select("repo", "file", F.col("var").alias("id"), "field", "change_id", "_to", "detail").distinct()
    return out.unionByName(_site(reads.join(local, [*HERE, "id", "field"]), "response.member", why, F.col("_to"), "rename-response-field", "medium"))


def _review_urls(hits: DataFrame) -> DataFrame:
    own = F.col("kind").isin("path.renamed", "request.field.renamed", "response.field.renamed", "operation.added")
    h = hits.filter(~own & ~F.col("direction").eqNullSafe(F.lit("response"))).withColumn("text", F.col("url_text"))
    return _site(h, _how(), F.coalesce("detail", F.col("kind")))


def _client_methods(code: Code, changes: DataFrame) -> DataFrame:
    """Calls `x.operationId(` of a removed operation, in camel or snake case."""
    gone = changes.filter("kind = 'operation.removed' AND operation_id IS NOT NULL AND operation_id <> ''")
    own = [c for c in ("repo",) if c in changes.columns]
    names = gone.select(*own, F.col("id").alias("change_id"), "operation_id", F.explode(F.array_distinct(F.array("operation_id", snake_case("operation_id")))).alias("last"))
    used = code.of("call", name="text", text="last", at="start_at", end_at="end_at", line="line").filter(F.col("text").contains("."))
    return _site(used.join(names, [*own, "last"]), "client.method", F.concat_ws(" ", F.lit("calls"), "operation_id", F.lit("which is gone")), confidence="medium")


def find_sites(files: DataFrame, changes: DataFrame, wrappers: Iterable[Wrapper | str] | DataFrame = (), base_urls: DataFrame | None = None) -> DataFrame:
    """Sites of breaking changes in files (repo, file, content); changes with a column `repo` are of that repository's contract.

    Returns the columns SITE. Renamed paths, request properties of the call's own payload and response fields have replacements:
    those of declared types with high confidence, those of local variables with medium. One place is one site for a reason,
    the one that has a replacement if any. Files without requests, null and empty ones give none; a file that stands twice is
    read twice and its sites are one. The result is a written table.
    """
    breaking = changes.filter("breaking")
    code = Code(files)
    if not isinstance(wrappers, DataFrame):
        wrappers = wrapper_table(code.spark, wrappers)
    hits = code.keep(match_calls(http_calls(code, wrappers, base_urls), breaking), "code-hits")
    found = _renamed_paths(hits)
    for more in (_renamed_request_fields(code, hits), _response_sites(code, hits), _review_urls(hits), _client_methods(code, breaking)):
        found = found.unionByName(more)
    out, _ = written(dedupe_sites(found, "change_id", ["repo", "file"]), "code-sites")
    code.close()
    return out
