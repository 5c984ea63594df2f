"""What the field learns, and that its moves from label to label decide."""

import numpy as np
import pytest

from codekiln.llm import clauses
from codekiln.llm.crf import Field
from codekiln.llm.pair_defects import defects_of

CPP = "#include <vector>\nusing namespace std;\n\nint total(const vector<int>& items) {\n    int sum = 0;\n    for (int i = 0; i < items.size(); i++) {\n        sum += items[i];\n    }\n    return sum;\n}\n"
# Only the first block shows that this is Python.
PYTHON = "def total(items):\n    return sum(items) if items is not None else None\n\n" + "\n\n".join(f"count_{k} = total_{k} * 2 + start_{k}\nrest_{k} = count_{k} - 1" for k in range(6)) + "\n"


@pytest.fixture(scope="module")
def field():
    return clauses.trained_field()


def test_moves_decide(field):
    still = Field(field.weights, np.zeros_like(field.moves), np.zeros_like(field.first))
    assert defects_of([CPP], [PYTHON], field) == ["other_language"]
    assert defects_of([CPP], [PYTHON], still) == [None]


def test_what_is_said_is_learnt(field):
    said = {
        "I'm sorry, but I cannot rewrite this module.": "refusal",
        "// I would rather not touch the parser code": "refusal",
        "Lo siento, no puedo mejorar este programa.": "refusal",
        "この関数はもう十分に速いです。": "other_language",
        "You could keep the size in a variable and stop earlier.": None,
    }
    assert defects_of([CPP] * len(said), list(said), field) == list(said.values())


def test_refusals_of_a_language_that_was_left_out(monkeypatch):
    """Words that languages share, and what refusals have in common, carry some way."""
    field = clauses.trained_field("es")
    monkeypatch.setattr(clauses, "_REFUSALS", {"es": clauses._REFUSALS["es"]})
    found, labels = clauses._training_sample(seed=5, rows=330)
    spanish = [k for k, own in enumerate(labels) if (own == clauses.REFUSAL).all()]
    got = clauses.label_clauses(field, [found[k] for k in spanish])
    assert len(spanish) > 50 and np.mean([(own == clauses.REFUSAL).mean() >= 0.3 for own in got]) > 0.6


def test_scores_are_those_of_the_wide_rows(field):
    made = clauses.described(CPP, "Sorry, no.\n\nPlease ask a maintainer.")
    assert np.allclose(made.scores(field), made.wide() @ field.weights, atol=1e-4)


def test_labels_do_not_depend_on_what_is_decoded_together(field, monkeypatch):
    from codekiln.llm import crf

    found, _ = clauses._training_sample(seed=3, rows=120)
    whole = clauses.label_clauses(field, found)
    alone = [clauses.label_clauses(field, [d])[0] for d in found]
    monkeypatch.setattr(crf, "_CELLS", 7)
    few = clauses.label_clauses(field, found)
    assert all((a == b).all() and (a == c).all() for a, b, c in zip(whole, alone, few, strict=True))


def test_a_very_long_answer(field):
    program = "int a = 1;\n\n" * 20_000
    assert defects_of([CPP, CPP], [program, "No."], field)[0] is None
