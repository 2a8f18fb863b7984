"""Container images: layers merged to a file table, OS detection, package databases, configuration checks."""

from __future__ import annotations

import io
import re
import tarfile
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisark import schemas
from palisark.session import BROADCAST_ROWS, written
from palisark.sources import files as file_sources
from palisark.sources import lockfiles

MAX_LAYER_BYTES = 2 << 30
MAX_FILES = 500_000
#: Contents that go out of a task at once, about.
BATCH_BYTES = 16 << 20
#: Families by package manager, and the files that tell the OS in order of precedence.
FAMILIES = {
    "apk": ("alpine",),
    "dpkg": ("debian", "ubuntu", "linuxmint", "kali", "raspbian", "pop"),
    "rpm": ("rhel", "centos", "fedora", "rocky", "almalinux", "ol", "amzn", "opensuse", "opensuse-leap", "sles", "suse", "photon"),
}
OS_FILES = (
    "etc/os-release", "usr/lib/os-release", "etc/alpine-release", "etc/debian_version", "etc/redhat-release", "etc/centos-release", "etc/lsb-release",
)
SECRET_ENV = r"(?i)(password|passwd|secret|token|api_?key|private_?key|access_?key|credential)"


def safe_path(path: str) -> str | None:
    """A path inside the image without a leading slash; None if it leads out of it."""
    parts: list[str] = []
    for p in path.replace("\\", "/").split("/"):
        if p in ("", "."):
            continue
        if p == "..":
            return None
        parts.append(p)
    return "/".join(parts) or None


def read_layers(layers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What layer archives hold (image, layer, content: tar, gzipped or not), without any contents.

    files: image, layer, path, place (of the member in its archive), size; of a path that an archive repeats, the last.
    removals: image, path, layer: what a whiteout removes of lower layers; an opaque one removes all below its folder (path
    ends in '/'). A broken archive has no rows; paths that lead out are refused. A layer of more than MAX_LAYER_BYTES or
    with more than MAX_FILES members is an error: nothing is left out in silence. The listing is written once.
    """

    columns = ["image", "layer", "path", "place", "size", "kind"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for image, layer, content in zip(x["image"], x["layer"], x["content"]):
                if content is None:
                    continue
                if len(content) > MAX_LAYER_BYTES:
                    raise ValueError(f"layer {layer} of {image}: {len(content)} bytes, more than {MAX_LAYER_BYTES}")
                found: dict[tuple[str, str], tuple[int, int]] = {}
                try:
                    with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                        for n, member in enumerate(tar):
                            if n >= MAX_FILES:
                                raise ValueError(f"layer {layer} of {image}: more than {MAX_FILES} members")
                            path = safe_path(member.name)
                            if path is None:
                                continue
                            folder, _, name = path.rpartition("/")
                            if name == ".wh..wh..opq":
                                found[folder + "/", "gone"] = n, 0
                            elif name.startswith(".wh."):
                                found[f"{folder}/{name[4:]}".lstrip("/"), "gone"] = n, 0
                            elif member.isfile():
                                found[path, "file"] = n, member.size
                except (tarfile.TarError, EOFError, OSError):
                    continue
                yield pd.DataFrame([(image, layer, path, n, size, kind) for (path, kind), (n, size) in found.items()], columns=columns)

    listed = layers.select("image", "layer", "content").mapInPandas(run, "image string, layer int, path string, place int, size long, kind string")
    listed = written(listed, "layer-files")
    return listed.where("kind = 'file'").drop("kind"), listed.where("kind = 'gone'").select("image", "path", "layer")


def merge_layers(files: DataFrame, removals: DataFrame) -> DataFrame:
    """The file of the highest layer at each path, unless a higher layer removes it, its folder or all in its folder.

    A removal is looked up by the file's path and each of its folders: equi-joins, no prefix comparison. Further columns of
    ``files`` are carried; contents had better be read afterwards, for what is wanted (``read_contents``).
    """
    parts = F.split("path", "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    names = F.array_union(ups, F.transform(F.filter(ups, lambda p: p != F.col("path")), lambda p: F.concat(p, F.lit("/"))))
    top = removals.groupBy("image", "path").agg(F.max("layer").alias("gone_at")).withColumnRenamed("path", "name")
    carried = [c for c in files.columns if c not in ("image", "path")]
    kept = files.groupBy("image", "path").agg(F.max_by(F.struct(*carried), "layer").alias("r")).select("image", "path", "r.*")
    last = kept.select("image", "path", "layer")
    dead = (
        last.select("image", "path", "layer", F.explode(F.array_union(names, F.array(F.lit("/")))).alias("name"))
        .join(top, ["image", "name"]).where("gone_at > layer").select("image", "path").distinct()
    )
    return kept.join(dead, ["image", "path"], "left_anti")


def read_contents(layers: DataFrame, files: DataFrame) -> DataFrame:
    """``files`` (image, path, layer, place) with their contents, read from the archives they lie in.

    What moves is the list of wanted files, a row for each layer: it is broadcast up to a checked number of files; beyond
    it, layers and lists are joined by shuffle.
    """
    wanted = files.groupBy("image", "layer").agg(F.collect_list(F.struct("place", "path")).alias("wanted"))
    wanted = written(wanted, "wanted-files")
    few = (wanted.agg(F.sum(F.size("wanted"))).first()[0] or 0) <= BROADCAST_ROWS
    both = layers.select("image", "layer", "content").join(F.broadcast(wanted) if few else wanted, ["image", "layer"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for image, layer, content, wanted in zip(x["image"], x["layer"], x["content"], x["wanted"]):
                places = {w["place"]: w["path"] for w in wanted}
                rows, size = [], 0
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    for n, member in enumerate(tar):
                        if n in places:
                            rows.append((image, layer, places.pop(n), tar.extractfile(member).read()))
                            size += member.size
                        if size >= BATCH_BYTES:
                            yield pd.DataFrame(rows, columns=["image", "layer", "path", "content"])
                            rows, size = [], 0
                        if not places:
                            break
                yield pd.DataFrame(rows, columns=["image", "layer", "path", "content"])

    return both.mapInPandas(run, "image string, layer int, path string, content binary")


def wanted_files(path: Column) -> Column:
    """Whether a path is one of those that OS detection and package readers look at."""
    return path.isin(*OS_FILES) | path.rlike(DATABASES) | file_sources.is_lockfile(path) | path.rlike(METADATA)


def _shell(text: Column, key: str) -> Column:
    """The value of a shell assignment: the last one, without its quotes."""
    every = F.regexp_extract_all(text, F.lit(rf"(?m)^\s*{key}\s*=[ \t]*(.*?)\s*$"), F.lit(1))
    return F.regexp_replace(F.try_element_at(every, F.lit(-1)), r"""^(["'])(.*)\1$""", "$2")


def package_manager(family: Column, like: Column) -> Column:
    case = F
    for manager, names in FAMILIES.items():
        case = case.when(family.isin(*names), manager)
    case = case.when(family == "arch", "pacman")
    of_like = F.filter(
        F.transform(like, lambda x: F.when(x.isin(*FAMILIES["dpkg"]), "dpkg").when(x == "alpine", "apk").when(x.isin("rhel", "fedora", "suse"), "rpm")),
        lambda x: x.isNotNull(),
    )
    return case.otherwise(F.coalesce(F.get(of_like, F.lit(0)), F.lit("unknown")))


def detect_os(files: DataFrame) -> DataFrame:
    """image, family, name, version, version_codename, pkg_manager, id_like: from the first OS file that tells one."""
    rows = files.where(F.col("path").isin(*OS_FILES)).select("image", "path", F.decode("content", "UTF-8").alias("t"))
    t, p = F.col("t"), F.col("path")
    none = F.array().cast("array<string>")
    release = p.isin("etc/os-release", "usr/lib/os-release")
    lsb, redhat = p == "etc/lsb-release", p.isin("etc/redhat-release", "etc/centos-release")
    low = F.lower(t)
    hat = F.when(low.contains("red hat"), "rhel").when(low.contains("centos"), "centos").when(low.contains("amazon"), "amzn").otherwise("rhel")
    family = (
        F.when(release, F.lower(_shell(t, "ID"))).when(p == "etc/alpine-release", "alpine").when(p == "etc/debian_version", "debian").when(redhat, hat)
        .when(lsb, F.lower(_shell(t, "DISTRIB_ID")))
    )
    like = F.when(release, F.filter(F.split(F.lower(F.coalesce(_shell(t, "ID_LIKE"), F.lit(""))), r"\s+"), lambda x: x != "")).otherwise(none)
    version = (
        F.when(release, _shell(t, "VERSION_ID")).when(redhat, F.regexp_extract(t, r"(?i)release\s+([\d.]+)", 1)).when(lsb, _shell(t, "DISTRIB_RELEASE"))
        .otherwise(F.regexp_extract(t, r"^\s*(\S+)", 1))
    )
    names = {"alpine": "Alpine Linux", "debian": "Debian GNU/Linux", "rhel": "Red Hat Enterprise Linux", "centos": "CentOS Linux", "amzn": "Amazon Linux"}
    plain = reduce(lambda c, x: c.when(family == x[0], x[1]), names.items(), F)
    name = F.coalesce(F.when(release, _shell(t, "NAME")).when(lsb, _shell(t, "DISTRIB_DESCRIPTION")), plain, family)
    codename = F.when(release, _shell(t, "VERSION_CODENAME")).when(lsb, _shell(t, "DISTRIB_CODENAME"))
    place = F.array_position(F.array(*map(F.lit, OS_FILES)), p)
    told = rows.select(
        "image", place.alias("place"), family.alias("family"), name.alias("name"), F.coalesce(version, F.lit("")).alias("version"),
        F.coalesce(codename, F.lit("")).alias("version_codename"), like.alias("id_like"),
    ).where("family <> ''")
    first = told.groupBy("image").agg(F.min_by(F.struct("family", "name", "version", "version_codename", "id_like"), "place").alias("r")).select("image", "r.*")
    return first.withColumn("pkg_manager", package_manager(F.col("family"), F.col("id_like")))


def _field(stanza: Column, key: str) -> Column:
    return F.trim(F.coalesce(F.regexp_extract(stanza, rf"(?m)^{key}:[ \t]*(.*)$", 1), F.lit("")))


def apk_packages(files: DataFrame) -> DataFrame:
    """Packages of apk databases (image, text): stanzas of one-letter fields between blank lines."""
    s = F.col("s")
    stanza = files.select("image", F.explode(F.split("text", r"\n[ \t]*\n")).alias("s")).where(F.col("s").rlike("(?m)^P:"))
    name, version = _field(s, "P"), _field(s, "V")
    return stanza.select(
        "image", name.alias("name"), version.alias("version"), F.lit("").alias("release"), F.lit(0).alias("epoch"), _field(s, "A").alias("arch"),
        F.when(s.rlike("(?m)^o:"), _field(s, "o")).otherwise(name).alias("source_name"), version.alias("source_version"), _field(s, "L").alias("license"),
    )


def dpkg_packages(files: DataFrame) -> DataFrame:
    """Installed packages of dpkg status files (image, text); a source is 'name' or 'name (version)'."""
    s = F.col("s")
    stanza = files.select("image", F.explode(F.split("text", "\n\n")).alias("s"))
    words = F.split(F.lower(_field(s, "Status")), r"\s+")
    kept = stanza.where((_field(s, "Package") != "") & ~F.arrays_overlap(words, F.array(F.lit("deinstall"), F.lit("purge"))))
    name, version = _field(s, "Package"), _field(s, "Version")
    source = F.coalesce(F.nullif(_field(s, "Source"), F.lit("")), name)
    return kept.select(
        "image", name.alias("name"), version.alias("version"), F.lit("").alias("release"), F.lit(0).alias("epoch"), _field(s, "Architecture").alias("arch"),
        F.trim(F.substring_index(source, "(", 1)).alias("source_name"),
        F.when(source.contains("("), F.trim(F.regexp_extract(source, r"\(([^)]*)", 1))).otherwise(version).alias("source_version"), F.lit("").alias("license"),
    )


#: Fixed values of the RPM format: header magic, tags, types, Berkeley DB hash pages.
RPM_MAGIC = b"\x8e\xad\xe8\x01"
RPM_TAGS = {1000: "name", 1001: "version", 1002: "release", 1003: "epoch", 1014: "license", 1022: "arch", 1044: "source_rpm"}
RPM_STRING, RPM_INT32 = 6, 4
BDB_HASH_MAGIC = 0x00061561
BDB_HASH_PAGES, BDB_OVERFLOW_PAGE, BDB_INLINE, BDB_OFF_PAGE = (2, 13), 7, 1, 3


def rpm_header(blob: bytes) -> dict | None:
    """The package that a header blob describes: an index of (tag, type, offset, count) over a store of values.

    Package files put a magic before the two counts; databases leave it out.
    """
    at = blob.find(RPM_MAGIC)
    if at < 0 and len(blob) >= 8 and 8 + 16 * int.from_bytes(blob[:4], "big") + int.from_bytes(blob[4:8], "big") == len(blob):
        at = -8
    if at == -1 or at + 16 > len(blob):
        return None
    entries, size = int.from_bytes(blob[at + 8 : at + 12], "big"), int.from_bytes(blob[at + 12 : at + 16], "big")
    index, store = at + 16, at + 16 + 16 * entries
    if store + size > len(blob):
        return None
    values, found = blob[store : store + size], {}
    for i in range(entries):
        tag, kind, offset = (int.from_bytes(blob[p : p + 4], "big") for p in range(index + 16 * i, index + 16 * i + 12, 4))
        if tag in RPM_TAGS and kind == RPM_STRING and offset < size:
            found[RPM_TAGS[tag]] = values[offset:].split(b"\0", 1)[0].decode("utf-8", "replace")
        elif tag in RPM_TAGS and kind == RPM_INT32 and offset + 4 <= size:
            found[RPM_TAGS[tag]] = int.from_bytes(values[offset : offset + 4], "big")
    name = str(found.get("name", ""))
    if not name:
        return None
    source = str(found.get("source_rpm", "")).removesuffix(".src.rpm").rsplit("-", 2)
    text = lambda k: str(found.get(k, ""))
    return {
        "name": name, "version": text("version"), "release": text("release"), "epoch": found.get("epoch", 0) if isinstance(found.get("epoch", 0), int) else 0,
        "arch": text("arch"), "source_name": source[0] if len(source) == 3 else name, "source_version": source[1] if len(source) == 3 else text("version"), "license": text("license"),
    }


def rpm_blobs(content: bytes) -> Iterator[bytes]:
    """The header blobs of a package database: SQLite's Packages table, a Berkeley DB hash file's values, or what else
    holds headers one after the other."""
    if content.startswith(b"SQLite format 3\0"):
        import sqlite3

        db = sqlite3.connect(":memory:")
        try:
            db.deserialize(content)
            yield from (bytes(b) for (b,) in db.execute("SELECT blob FROM Packages"))
        except sqlite3.DatabaseError:
            return
        finally:
            db.close()
        return
    order = next((o for o in ("little", "big") if int.from_bytes(content[12:16], o) == BDB_HASH_MAGIC), None)
    if order:
        yield from bdb_values(content, order)
        return
    starts = [m.start() for m in re.finditer(re.escape(RPM_MAGIC), content)]
    for at, end in zip(starts, [*starts[1:], len(content)]):
        yield content[at:end]


def bdb_values(content: bytes, order: str) -> Iterator[bytes]:
    """The values of a Berkeley DB hash file: those inside its hash pages, and those put together from overflow pages.

    A page has a header (its follower at 16, items at 20, free space or length at 22, its type at 25), then the places of
    its items, which lie from its end down: keys and values by turns. A value off the page names its first overflow page
    and its length. Each page is read once for each value that lies on it; a chain that doesn't end, or leads nowhere, has
    no value.
    """
    number = lambda at, size: int.from_bytes(content[at : at + size], order)
    page = number(20, 4)
    if page < 512 or page & (page - 1) or page > 65536:
        return
    for base in range(page, len(content) - page + 1, page):
        if content[base + 25] not in BDB_HASH_PAGES:
            continue
        items = min(number(base + 20, 2), (page - 26) // 2)
        places = [number(base + 26 + 2 * i, 2) for i in range(items)]
        for i in range(1, items, 2):
            at, end = base + places[i], base + places[i - 1]
            if not base + 26 + 2 * items <= at < end <= base + page:
                continue
            if content[at] == BDB_INLINE:
                yield content[at + 1 : end]
            elif content[at] == BDB_OFF_PAGE and end - at >= 12:
                next_page, left, parts = number(at + 4, 4), number(at + 8, 4), []
                for _ in range(-(-left // (page - 26))):
                    start = next_page * page
                    if not next_page or start + page > len(content) or content[start + 25] != BDB_OVERFLOW_PAGE:
                        break
                    parts.append(content[start + 26 : start + 26 + min(number(start + 22, 2), page - 26, left)])
                    left -= len(parts[-1])
                    next_page = number(start + 16, 4)
                if left == 0:
                    yield b"".join(parts)


def rpm_packages(files: DataFrame) -> DataFrame:
    """Packages of RPM databases (image, content)."""
    schema = "image string, " + schemas.OS_PACKAGE

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = [{"image": i} | p for i, c in zip(x["image"], x["content"]) for b in rpm_blobs(c) if (p := rpm_header(b))]
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in schema.split(", ")])

    return files.select("image", "content").mapInPandas(run, schema)


def installed_packages(files: DataFrame) -> DataFrame:
    """All OS packages of merged image files (image, path, content), by the databases that are there."""
    text = files.withColumn("text", F.decode("content", "UTF-8"))
    apk = apk_packages(text.where("path = 'lib/apk/db/installed'"))  # DATABASES names all of these
    dpkg = dpkg_packages(text.where("path = 'var/lib/dpkg/status' or (path like 'var/lib/dpkg/status.d/%' and path not like '%.md5sums')"))
    rpm = rpm_packages(files.where(F.col("path").rlike(r"^(usr/lib/sysimage|var/lib)/rpm/(rpmdb\.sqlite|Packages)$")))
    return apk.unionByName(dpkg).unionByName(rpm)


#: Package databases.
DATABASES = r"^(lib/apk/db/installed|var/lib/dpkg/status|var/lib/dpkg/status\.d/.+|(usr/lib/sysimage|var/lib)/rpm/(rpmdb\.sqlite|Packages))$"
#: Where Python's installed packages tell name, version and licence.
METADATA = r"(^|/)(site|dist)-packages/[^/]+/(METADATA|PKG-INFO)$"


def app_packages(files: DataFrame) -> DataFrame:
    """Dependencies (``schemas.DEPENDENCY`` without ord, and image) of merged image files (image, path, content).

    Those of lock files outside hidden and vendored folders, and those that Python's package metadata tells; each name
    and version counts once for a file, and once for an image's metadata.
    """
    folders = F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1)
    locks = files.where(file_sources.is_lockfile(F.col("path")) & ~F.exists(folders, lambda d: d.isin("node_modules", "__pycache__") | d.startswith(".")))
    named = locks.select(F.concat_ws("\0/", "image", "path").alias("source_file"), F.decode("content", "UTF-8").alias("text"))
    locked = lockfiles.dependencies(named).select(
        F.substring_index("source_file", "\0/", 1).alias("image"), F.substring_index("source_file", "\0/", -1).alias("source_file"), "name", "version", "ecosystem", "license"
    )
    head = F.split(F.decode("content", "UTF-8"), r"\r?\n\r?\n")[0]
    told = files.where(F.col("path").rlike(METADATA)).select(
        "image", F.col("path").alias("source_file"), _field(head, "Name").alias("name"), _field(head, "Version").alias("version"), _field(head, "License").alias("license")
    )
    first = told.where("name <> '' and version <> ''").groupBy("image", "name", "version").agg(F.min(F.struct("source_file", "license")).alias("r"))
    python = first.select("image", "r.source_file", "name", "version", F.lit("pypi").alias("ecosystem"), "r.license")
    return locked.unionByName(python)


def of_folder(found: DataFrame, name: str = "filesystem") -> DataFrame:
    """Files of ``files.walk`` as one image's files, so that OS and packages of an unpacked folder are read alike."""
    return found.select(F.lit(name).alias("image"), F.col("rel").alias("path"), "content")


def config_findings(configs: DataFrame) -> DataFrame:
    """Misconfigurations of image configurations (image, config VARIANT): image, id, title, severity, detail."""
    c = F.col("config")
    text = lambda p: F.coalesce(F.try_variant_get(c, p, "string"), F.lit(""))
    env = F.coalesce(F.try_variant_get(c, "$.config.Env", "array<string>"), F.array().cast("array<string>"))
    secret = F.transform(F.filter(env, lambda e: e.rlike(SECRET_ENV)), lambda e: F.substring_index(e, "=", 1))
    ports = F.map_keys(F.coalesce(F.try_variant_get(c, "$.config.ExposedPorts", "map<string,variant>"), F.create_map().cast("map<string,variant>")))
    low = F.filter(ports, lambda p: F.coalesce(F.substring_index(p, "/", 1).try_cast("int") < 1024, F.lit(False)))
    health = F.try_variant_get(c, "$.config.Healthcheck", "variant")
    no_health = F.coalesce(F.to_json(health).isin("null", "{}", "[]", '""', "false"), F.lit(True))
    labels = lambda k: F.coalesce(F.try_variant_get(c, f"$.config.Labels['{k}']", "string"), F.lit(""))
    empty = F.lit("")
    checks = (
        (text("$.config.User").isin("", "0", "root"), "IMG_ROOT_USER", "Container runs as root", "high", empty),
        (no_health, "IMG_NO_HEALTHCHECK", "No HEALTHCHECK defined", "medium", empty),
        (F.size(secret) > 0, "IMG_SECRET_IN_ENV", "Possible secret in environment variable", "critical", F.array_join(secret, ", ")),
        (F.size(low) > 0, "IMG_PRIVILEGED_PORT", "Privileged port exposed", "low", F.array_join(low, ", ")),
        ((labels("maintainer") == "") & (labels("org.opencontainers.image.authors") == ""), "IMG_NO_MAINTAINER", "No maintainer label", "info", empty),
    )
    made = [F.when(ok, F.struct(F.lit(i).alias("id"), F.lit(t).alias("title"), F.lit(s).alias("severity"), d.alias("detail"))) for ok, i, t, s, d in checks]
    return configs.select("image", F.explode(F.array_compact(F.array(*made))).alias("x")).select("image", "x.*")


def redacted_env(env: Column) -> Column:
    """Environment entries with the values of secret-like names hidden."""
    return F.transform(env, lambda e: F.when(e.rlike(SECRET_ENV), F.concat(F.substring_index(e, "=", 1), F.lit("=***"))).otherwise(e))


def reference(raw: Column) -> Column:
    """registry, repository, tag and digest of an image reference; a tag of 'latest' where it has neither tag nor digest."""
    digest = F.when(raw.contains("@"), F.substring_index(raw, "@", -1)).otherwise("")
    name = F.when(raw.contains("@"), F.regexp_replace(raw, "@[^@]*$", "")).otherwise(raw)
    tagged = (digest == "") & name.rlike(":[^/:]*$")
    tag = F.when(tagged, F.regexp_extract(name, ":([^/:]*)$", 1)).when(digest == "", "latest").otherwise("")
    path = F.when(tagged, F.regexp_replace(name, ":[^/:]*$", "")).otherwise(name)
    first = F.substring_index(path, "/", 1)
    hosted = path.contains("/") & (first.contains(".") | first.contains(":") | (first == "localhost"))
    hub = "registry-1.docker.io"
    registry = F.when(hosted & (first != "docker.io"), first).otherwise(hub)
    repository = F.when(hosted, F.regexp_replace(path, "^[^/]*/", "")).when(path.contains("/"), path).otherwise(F.concat(F.lit("library/"), path))
    return F.struct(registry.alias("registry"), repository.alias("repository"), tag.alias("tag"), digest.alias("digest"))


def pick_platform(manifests: DataFrame, os: str = "linux", arch: str = "amd64") -> DataFrame:
    """Of an index's manifests (image, ord, os, arch, digest) the exact platform's, else the first of the same OS."""
    rank = F.when((F.col("os") == os) & (F.col("arch") == arch), 0).when(F.col("os") == os, 1)
    return manifests.where(rank.isNotNull()).groupBy("image").agg(F.min_by("digest", F.struct(rank, "ord")).alias("digest"))


def verified_blobs(blobs: DataFrame) -> DataFrame:
    """The blobs (digest, content) whose content has the digest they are named by."""
    return blobs.where(F.col("digest") == F.concat(F.lit("sha256:"), F.sha2("content", 256)))


#: The counts of an image's summary.
COUNTED = ("os_packages", "os_vulnerabilities", "app_dependencies", "app_vulnerabilities", "secrets", "misconfigs")


def summary(counted: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """A row for each image: how many rows of each kind (one of COUNTED) it has, and total_vulnerabilities.

    ``images``: those that have a row in any case, of zeros if nothing was found.
    """
    if images is not None:
        counted = counted.unionByName(images.select("image", F.lit("none").alias("kind")).distinct())
    out = counted.groupBy("image").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in COUNTED])
    return out.withColumn("total_vulnerabilities", F.col("os_vulnerabilities") + F.col("app_vulnerabilities"))
