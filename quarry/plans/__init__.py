"""Plans over operators: registry, closed loop, registered queries."""
