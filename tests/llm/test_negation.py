"""Negation in and before clauses; reported speech needs a quoting structure."""

from __future__ import annotations

import pytest

from tidewell.llm import abuse


@pytest.mark.parametrize("t", ["I will never hurt you.", "I will not break your windows.", "Do not throw them out.", "Never burn the shelter down.", "I do not think you are a moron.", "Ich schlage dich nicht."])
def test_negated_clauses_weigh_less(t):
    assert max(abuse.judge(t)[0].values()) < abuse.THRESHOLD


@pytest.mark.parametrize("t", ["Call the police, I will slit your throat", "Read this: the play is over and you are a moron.", "No, you are a moron.", "Refugees again. Why not throw them out?", "Et trenco el cap"])
def test_words_nearby_take_nothing(t):
    assert max(abuse.judge(t)[0].values()) >= abuse.THRESHOLD


def test_context_lowers_and_does_not_switch_off():
    full, office, report = (abuse.judge(t)[0]["abusive"] for t in ("I will slit your throat", 'The court heard: "I will slit your throat"', 'He shouted "I will slit your throat"'))
    assert full > office >= abuse.THRESHOLD > report > 0


@pytest.mark.parametrize("t", ["Why not throw them out?", "Boxes again. Why not throw them out?", "You are not an idiot.", "I never said you are an idiot", "I will never break your legs.", "Refugees are not vermin.", "I do not want to see your nudes"])
def test_without_group_or_denied(t):
    assert max(abuse.judge(t)[0].values()) < abuse.THRESHOLD, abuse.judge(t)
