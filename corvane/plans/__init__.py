"""Three plans for a pattern, which agree, and the planner that picks one.

* ``arrays`` scans the sentence table: no shuffle, the default where sentences bound matches.
* ``joins`` intersects token scans, or index probes, by position: for patterns that cross sentences, and
  for selective literals with an index.
* ``window`` looks ahead in the token table: one shuffle by sentence; kept as a cross-check.
"""
