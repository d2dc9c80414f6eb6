"""Flow generators: destination probabilities per origin, emitted onto given outflows.

All work on the pair table of :func:`odflow.operators.zones.zone_pairs`, which is hash-partitioned by
(area, origin); every row-wise step below keeps that partitioning.
"""
