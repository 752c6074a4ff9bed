"""Small corpora, written as files and built through the readers."""

from corvane.cli import build_corpus


def tsv(path, features, rows, compress=None):
    """A file of tokens: a list of rows, or None for the end of a sentence."""
    lines = ["\t".join(features), *("# " if r is None else "\t".join(r) for r in rows)]
    body = ("\n".join(lines) + "\n").encode()
    path.write_bytes(compress(body) if compress else body)
    return f"file://{path}"


def words(spark, folder, name, text):
    """A corpus with the feature ``word``; sentences are separated by ``|``."""
    rows = []
    for s in text.split("|"):
        rows += [None, *((w,) for w in s.split())]
    return build_corpus(spark, f"file://{folder}", tsv(folder / f"{name}.tsv", ["word"], rows))
