"""Scoring, evaluation and decode-trace analytics for language-model rollouts, as Spark jobs.

The public jobs are in ``rollscore.plans.jobs``; the pieces they are made of are in
``functions`` (Column expressions), ``operators`` (table in, table out), ``sources`` and
``streaming``.
"""
