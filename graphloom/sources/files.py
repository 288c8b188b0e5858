"""Files of a source tree, by language, with what each language leaves out; and the dependencies of build files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders that hold no sources, by language.
_BUILT = ("build", ".gradle", "node_modules", ".dart_tool")
LEFT_OUT = {
    "java": _BUILT,
    "groovy": _BUILT,
    "dart": _BUILT,
    "typescript": ("node_modules",),
    "shell": ("build", ".gradle", "node_modules", "navigators", "target"),
    "sql": ("build", "target", "node_modules", ".gradle", "navigators", "out", "dist"),
    "python": ("venv", ".venv", "env", "__pycache__", ".tox", "site-packages", "build", "dist", "node_modules", "navigators", ".gradle"),
}
EXTENSIONS = {"java": "java", "ts": "typescript", "groovy": "groovy", "dart": "dart", "py": "python", "sh": "shell", "sql": "sql"}


def language(path: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in EXTENSIONS.items() for x in pair))
    return table[F.regexp_extract(path, r"\.(\w+)$", 1)]


def is_source(path: Column) -> Column:
    """Whole path segments are compared, so that a folder like ``builders`` stays in."""
    parts = F.split(path, "/")
    left_out = F.create_map(*(x for k, v in LEFT_OUT.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    inside = ~F.coalesce(F.arrays_overlap(folders, left_out[language(path)]), F.lit(False))
    no_egg = ~(path.endswith(".py") & F.exists(parts, lambda p: p.endswith(".egg-info")))
    ts = ~path.endswith(".spec.ts") & ~path.endswith(".d.ts") & ~path.endswith(".module.ts")
    dart = ~path.endswith(".g.dart") & ~path.endswith(".freezed.dart") & ~path.contains("/l10n/")
    return inside & no_egg & ts & dart & ~path.contains(".claude/worktrees/")


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(file_path, language, content, last_modified, checksum) of the sources under ``root``, paths relative to it."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/")
    path = F.regexp_extract("path", r"^(?:\w+:/*)?/?" + base.lstrip("/").replace(".", r"\.") + r"/(.*)$", 1)
    own = raw.select(path.alias("file_path"), F.decode("content", "UTF-8").alias("content"), F.unix_millis("modificationTime").alias("last_modified"), F.sha2("content", 256).alias("checksum"))
    return own.withColumn("language", language(F.col("file_path"))).where(F.col("language").isNotNull() & is_source(F.col("file_path")))


# The configurations of a Gradle file whose entries are dependencies.
CONFIGURATIONS = ("implementation", "api", "compileOnly", "runtimeOnly", "testImplementation", "testRuntimeOnly", "annotationProcessor")


def dependencies(text: Column) -> Column:
    """Array of (group, artifact, version) of a build file, in order, each once: Gradle's short and map forms, and Maven's."""
    gradle = F.regexp_extract_all(text, F.lit(rf"""(?:{"|".join(CONFIGURATIONS)})\s*\(?\s*["']([\w.-]+:[\w.-]+(?::[\w.-]+)?)["']"""), F.lit(1))
    named = F.regexp_extract_all(text, F.lit(r"""(group\s*[:=]\s*["'][^"']+["']\s*,\s*name\s*[:=]\s*["'][^"']+["'](?:\s*,\s*version\s*[:=]\s*["'][^"']+["'])?)"""), F.lit(1))
    maven = F.regexp_extract_all(text, F.lit(r"(?s)<dependency>(.*?)</dependency>"), F.lit(1))
    short = F.transform(gradle, lambda x: F.struct(F.split(x, ":")[0].alias("g"), F.split(x, ":")[1].alias("a"), F.coalesce(F.get(F.split(x, ":"), F.lit(2)), F.lit("")).alias("v")))

    def attribute(x: Column, name: str) -> Column:
        return F.regexp_extract(x, name + r"""\s*[:=]\s*["']([^"']+)["']""", 1)

    mapped = F.transform(named, lambda x: F.struct(attribute(x, "group").alias("g"), attribute(x, "name").alias("a"), attribute(x, "version").alias("v")))

    def tag(x: Column, name: str) -> Column:
        return F.trim(F.regexp_extract(x, f"<{name}>([^<]*)</{name}>", 1))

    poms = F.transform(maven, lambda x: F.struct(tag(x, "groupId").alias("g"), tag(x, "artifactId").alias("a"), tag(x, "version").alias("v")))
    return F.array_distinct(F.concat(short, mapped, poms))
