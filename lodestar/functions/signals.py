"""Route, query and intent signals, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import no_strings, nonempty, normalize_terms, path_segments, singularize

# Fixed vocabularies.
VERB_INTENT = {"post": "create", "put": "update", "patch": "update", "delete": "delete", "get": "read"}
QUERY_ALIASES = {
    "create": "create add new insert post register submit".split(), "update": "update edit modify put patch change".split(),
    "delete": "delete remove destroy drop".split(), "read": "read get fetch find list show retrieve".split(),
}
STOP_TERMS = "the this that with from into where when which what does should route endpoint http api resource".split()
LOGGING = "log logger logging audit trace".split()
ANALYTICS = "analytics metric metrics telemetry tracking event".split()
INDEX_HINTS = {
    "create": "create insert add register new post".split(), "update": "update modify edit patch put upsert".split(),
    "delete": "delete remove destroy drop".split(), "read": "get fetch read list find retrieve query".split(),
}
SYMBOL_SKIP = "create update delete get post put patch".split()

_VERBS = "get|post|put|delete|patch"
ROUTE_JS = rf"(?i)\.\s*({_VERBS})\s*\(\s*['\"]([^'\"]+)['\"]"
ROUTE_PY = rf"(?i)@[A-Za-z_][A-Za-z0-9_\.]*?\s*({_VERBS})\s*\(\s*['\"]([^'\"]+)['\"]"
ROUTE_GENERIC = rf"(?i)\b({_VERBS})\b"


def let(value: Column, body) -> Column:
    """Binds a value once: what ``body`` makes of it refers to it without evaluating it again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strings(values) -> Column:
    return F.array(*map(F.lit, values))


def verb_intent(method: Column) -> Column:
    out = F.lit(None).cast("string")
    for verb, intent in VERB_INTENT.items():
        out = F.when(F.lower(method) == verb, intent).otherwise(out)
    return out


def sorted_set(*arrays: Column) -> Column:
    return F.array_sort(F.array_distinct(F.concat(*[F.coalesce(a, no_strings()) for a in arrays])))


def first_resource(path: Column) -> Column:
    return singularize(F.get(normalize_terms(F.get(path_segments(F.coalesce(path, F.lit(""))), F.lit(0))), F.lit(0)))


def symbol_resource(symbol: Column) -> Column:
    return singularize(F.get(F.filter(normalize_terms(symbol), lambda t: ~t.isin(SYMBOL_SKIP)), F.lit(0)))


def route_signal(text: Column, symbol: Column) -> Column:
    """struct(method, intent, resource, path, structural_terms), null without any verb."""
    at = lambda p, i: nonempty(F.regexp_extract(text, p, i))
    found = F.struct(at(ROUTE_JS, 1).alias("js"), at(ROUTE_JS, 2).alias("js_path"), at(ROUTE_PY, 1).alias("py"), at(ROUTE_PY, 2).alias("py_path"),
                     at(ROUTE_GENERIC, 1).alias("word"), normalize_terms(symbol).alias("symbol"), symbol_resource(symbol).alias("thing"))

    def named(v: Column) -> Column:
        path = F.when(v["js"].isNotNull(), v["js_path"]).when(v["py"].isNotNull(), v["py_path"])
        return let(F.struct(F.coalesce(v["js"], v["py"], v["word"]).alias("method"), path.alias("path"), v["symbol"].alias("symbol"), v["thing"].alias("thing")), whole)

    def whole(v: Column) -> Column:
        method, path, intent = v["method"], v["path"], verb_intent(v["method"])
        resource = F.when(path.isNotNull(), first_resource(path)).otherwise(v["thing"])
        segments = F.flatten(F.transform(path_segments(F.coalesce(path, F.lit(""))), normalize_terms))
        terms = sorted_set(F.array(F.lower(method)), F.array(intent), segments, F.array_compact(F.array(resource)), v["symbol"])
        return F.when(method.isNotNull(), F.struct(F.upper(method).alias("method"), intent.alias("intent"), resource.alias("resource"), path.alias("path"), terms.alias("structural_terms")))

    return let(found, named)


def query_signal(query: Column) -> Column:
    """struct(intents, methods, structural_terms) of a query text."""
    terms = normalize_terms(query)
    methods = F.array_sort(F.array_intersect(F.array_distinct(terms), strings(VERB_INTENT)))
    hit = [F.when(F.arrays_overlap(terms, strings(words)), F.lit(intent)) for intent, words in QUERY_ALIASES.items()]
    intents = sorted_set(F.array_compact(F.array(*hit)), F.transform(methods, verb_intent))
    structural = sorted_set(F.array_except(terms, strings(STOP_TERMS)), methods, intents)
    return F.struct(intents.alias("intents"), methods.alias("methods"), structural.alias("structural_terms"))


def noise_tags(path: Column) -> Column:
    """Tags by substring of the path; seed and migration as written, test and script in any case."""
    low = F.lower(path)
    has = lambda c, *words: F.exists(strings(words), lambda w: F.contains(c, w))
    return F.array_compact(F.array(
        F.when(has(path, "seed"), F.lit("seed_data")), F.when(has(path, "migration"), F.lit("migration_script")),
        F.when(has(low, "test", "spec"), F.lit("test_script")), F.when(has(low, "script"), F.lit("script"))))


def intent_metadata(path: Column, kind: Column, symbol: Column, text: Column) -> Column:
    """struct(tags, route, structural_terms) of a chunk."""
    found = F.struct(normalize_terms(F.concat_ws("\n", path, F.coalesce(symbol, F.lit("")), F.left(text, F.lit(8000)))).alias("terms"), route_signal(text, symbol).alias("route"), noise_tags(path).alias("noise"))

    def whole(v: Column) -> Column:
        terms, route = v["terms"], v["route"]
        hints = [F.when(F.arrays_overlap(terms, strings(words)) | (route["intent"] == intent), F.lit(f"{intent}_resource")) for intent, words in INDEX_HINTS.items()]
        other = [F.when(F.arrays_overlap(terms, strings(LOGGING)), F.lit("logging")), F.when(F.arrays_overlap(terms, strings(ANALYTICS)), F.lit("analytics")),
                 F.when(route.isNotNull(), F.lit("route_handler"))]
        return F.struct(sorted_set(F.array_compact(F.array(*hints, *other)), v["noise"]).alias("tags"), route.alias("route"), sorted_set(terms, route["structural_terms"]).alias("structural_terms"))

    return let(found, whole)
