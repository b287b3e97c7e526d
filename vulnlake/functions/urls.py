"""URL, repository-name and file-name functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: RFC 3986 appendix B split; group 1 is the path (lenient on bad URLs).
URL_PATH_RE = r"^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)"
URL_NETLOC_RE = r"^(?:[^:/?#]+:)?//([^/?#]*)"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_github(url) -> Column:
    """The text ``github.com`` occurs anywhere in the URL."""
    return F.coalesce(_c(url).contains("github.com"), F.lit(False))


def url_path(url) -> Column:
    """Text after the authority, before ``?`` / ``#``."""
    return F.regexp_extract(F.coalesce(_c(url), F.lit("")), URL_PATH_RE, 1)


def url_netloc(url) -> Column:
    """Authority part of a URL (user info and port included), empty when absent."""
    return F.regexp_extract(F.coalesce(_c(url), F.lit("")), URL_NETLOC_RE, 1)


def url_host(url) -> Column:
    """Host name: the authority without user info and port, lower-cased."""
    return F.lower(F.regexp_extract(url_netloc(url), r"^(?:[^@]*@)?([^:]*)", 1))


def github_repo(url) -> Column:
    """``parts[1]/parts[2]`` of the path split on ``/`` when it has 3+ parts."""
    parts = F.split(url_path(url), "/")
    return F.when(F.size(parts) >= 3, F.concat(F.get(parts, 1), F.lit("/"), F.get(parts, 2)))


def github_commit(url) -> Column:
    """The path part after the first part equal to ``commit`` (may be empty)."""
    parts = F.split(url_path(url), "/")
    idx = F.array_position(parts, "commit")  # 1-based, 0 when absent
    return F.when(idx > 0, F.get(parts, idx.cast("int")))


def is_patch_url(url) -> Column:
    """P05."""
    return F.coalesce(_c(url).endswith(".patch"), F.lit(False))


def owner_repo(repository) -> Column:
    """``struct(owner, repo)`` when the name has exactly two parts, else null."""
    parts = F.split(_c(repository), "/")
    return F.when(F.size(parts) == 2, F.struct(F.get(parts, 0).alias("owner"), F.get(parts, 1).alias("repo")))


def repo_dir(repository) -> Column:
    """``owner/repo`` -> ``owner_repo``."""
    return F.replace(_c(repository), F.lit("/"), F.lit("_"))


def repo_from_dir(name) -> Column:
    """Inverse of P07 on *every* underscore (lossy for names holding ``_``)."""
    return F.replace(_c(name), F.lit("_"), F.lit("/"))


def patch_file_name(cve_id, repository) -> Column:
    """``{cve}_{owner_repo}.patch``."""
    return F.concat(_c(cve_id), F.lit("_"), repo_dir(repository), F.lit(".patch"))


def parse_patch_name(name) -> Column:
    """P10: ``struct(cve_id, repo)``; cve = text before the first ``_``; repo = the name with
    every ``{cve}_`` and then every ``.patch`` removed; empty values become null."""
    n = _c(name)
    cve = F.substring_index(n, "_", 1)
    repo = F.replace(F.replace(n, F.concat(cve, F.lit("_")), F.lit("")), F.lit(".patch"), F.lit(""))
    return F.struct(F.nullif(cve, F.lit("")).alias("cve_id"), F.nullif(repo, F.lit("")).alias("repo"))


def default_patch_url(patch_url, repository, fix_commit, has_details) -> Column:
    """Keep a truthy patch URL; else build one, only when commit details exist."""
    built = F.concat(F.lit("https://github.com/"), _c(repository), F.lit("/commit/"), _c(fix_commit), F.lit(".patch"))
    keep = F.nullif(_c(patch_url), F.lit(""))
    return F.when(_c(has_details) & _c(fix_commit).isNotNull() & (_c(fix_commit) != ""),
                  F.coalesce(keep, built)).otherwise(_c(patch_url))


def safe_name(s, null_value: str = "unknown_repository") -> Column:
    """Every char that is not a Unicode letter/digit nor ``._-`` becomes ``_``."""
    return F.coalesce(F.regexp_replace(_c(s), r"[^\p{L}\p{N}._-]", "_"), F.lit(null_value))


def url_file_name(url) -> Column:
    """``host_path.txt`` with ``/`` -> ``_`` and the P12 character rule; query ignored."""
    path = F.regexp_replace(url_path(url), "^/", "")
    raw = F.concat(url_netloc(url), F.lit("_"), F.replace(path, F.lit("/"), F.lit("_")))
    return F.concat(F.regexp_replace(raw, r"[^\p{L}\p{N}._-]", "_"), F.lit(".txt"))
