import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from lexweave.session import local_session

    session = local_session(8, "tests", str(tmp_path_factory.mktemp("shared")))
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def lexicon_dir(tmp_path_factory):
    """A small lexicon folder, the way a user supplies one."""
    folder = tmp_path_factory.mktemp("lexicon")
    files = {
        "invariables": "word\tpos\nna\tCONJUNCTION\nariko\tCONJUNCTION\nkandi\tCONJUNCTION\nngo\tVERB_PARTICLE\n"
        "ko\tVERB_PARTICLE\nku\tLOCATIVE\nmu\tLOCATIVE\nmuri\tLOCATIVE\nhano\tLOCATIVE\ncyane\tADVERB\nneza\tADVERB\n"
        "buhoro\tADVERB\nvuba\tADVERB\nni\tVERB_PARTICLE\nkuko\tCONJUNCTION\nniba\tCONJUNCTION\n",
        "pronouns": "word\tpron_type\tnoun_class\nuyu\tDEMONSTRATIVE\t1\niki\tDEMONSTRATIVE\t7\nnge\tPERSONAL\t0\n"
        "we\tPERSONAL\t0\nnde\tINTERROGATIVE\t0\niki\tINTERROGATIVE\t7\n",
        "known_words": "word\tnoun_class\tstem\nimvura\t9\tvura\nisi\t9\tsi\n",
        "verb_stems": "stem\ngend\nkor\nrem\nbon\nsom\nfash\nreb\nb\nh\ngir\nsab\n",
        "gloss_verbs": "key\tgloss\ngend\tgo\nkor\twork\nrem\tcreate\n",
        "gloss_nouns": "key\tgloss\nntu\tperson\nmana\tGod\n",
        "gloss_words": "key\tgloss\nneza\twell\nna\tand/with\nna\tshadowed\n",
    }
    for name, content in files.items():
        (folder / f"{name}.tsv").write_text(content, encoding="utf-8")
    return str(folder)


@pytest.fixture(scope="session")
def dims(spark, lexicon_dir):
    from lexweave.sources.dimensions import load_dimensions

    return load_dimensions(spark, lexicon_dir, optional=["documented"])
