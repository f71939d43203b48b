"""Path, language and repository-URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extension -> language, as the reference maps them.
EXTENSION_LANGUAGE = {
    ".go": "go",
    ".php": "php",
    ".py": "python",
    ".java": "java",
    ".js": "javascript",
    ".jsx": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
}

EXTENSIONS = [e[1:] for e in EXTENSION_LANGUAGE]

# Repository host -> provider.
HOST_PROVIDER = {"github.com": "github", "gitlab.com": "gitlab", "bitbucket.org": "bitbucket"}


def extension(path: Column) -> Column:
    """Lower-cased extension of the last path element ('' when none)."""
    base = F.substring_index(path, "/", -1)
    return F.lower(F.regexp_extract(base, r"(\.[^.]*)\z", 1))


def language(path: Column) -> Column:
    """B1: language from extension, 'unknown' otherwise."""
    ext = extension(path)
    expr = F.lit("unknown")
    for e, lang in reversed(list(EXTENSION_LANGUAGE.items())):
        expr = F.when(ext == e, F.lit(lang)).otherwise(expr)
    return expr


def display_path(path: Column, root: str) -> Column:
    """Strip the scan root, then one leading '/'."""
    rel = F.when(path.startswith(root), F.substr(path, F.lit(len(root) + 1))).otherwise(path) if root else path
    return F.when(rel.startswith("/"), F.substr(rel, F.lit(2))).otherwise(rel)


def basename(path: Column) -> Column:
    """Last path element."""
    return F.substring_index(path, "/", -1)


def repo_info(url: Column) -> Column:
    """struct(provider, owner, repo, error) from a repository URL.

    Host is matched exactly (case-sensitive, port ignored); the path is
    trimmed of '/' and split; '.git' is kept.
    """
    host = F.try_parse_url(url, F.lit("HOST"))
    raw_path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    parts = F.split(F.regexp_replace(raw_path, r"^/+|/+\z", ""), "/", -1)
    provider = F.lit(None).cast("string")
    for h, p in HOST_PROVIDER.items():
        provider = F.when(host == h, F.lit(p)).otherwise(provider)
    error = (
        F.when(F.coalesce(url, F.lit("")) == "", F.lit("empty repository URL"))
        .when(provider.isNull(), F.concat(F.lit("unsupported repository provider: "), F.coalesce(host, F.lit(""))))
        .when(F.size(parts) < 2, F.lit("invalid repository URL format"))
    )
    ok = error.isNull()
    return F.struct(
        F.when(ok, provider).alias("provider"),
        F.when(ok, F.get(parts, 0)).alias("owner"),
        F.when(ok, F.get(parts, 1)).alias("repo"),
        error.alias("error"),
    )


#: Characters that a path segment keeps and form encoding does not, and the one it escapes.
_SEGMENT_KEEPS = (("%40", "@"), ("%2B", "+"), ("%7E", "~"), ("%26", "&"), ("%3D", "="), ("%3A", ":"), ("%24", "$"))


def path_escape(text: Column) -> Column:
    """A text as one path segment: form encoding, then the characters that differ."""
    out = F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))
    for code, char in _SEGMENT_KEEPS:
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def raw_content_url(provider: Column, owner: Column, repo: Column, branch: Column, path: Column) -> Column:
    """Where a file's raw content lives for a provider and branch."""
    return (
        F.when(provider == "github", F.format_string("https://raw.githubusercontent.com/%s/%s/%s/%s", owner, repo, branch, path))
        .when(
            provider == "gitlab",
            F.format_string(
                "https://gitlab.com/api/v4/projects/%s%%2F%s/repository/files/%s/raw?ref=%s",
                owner,
                repo,
                path_escape(path),
                branch,
            ),
        )
        .when(provider == "bitbucket", F.format_string("https://api.bitbucket.org/2.0/repositories/%s/%s/src/%s/%s", owner, repo, branch, path))
    )
