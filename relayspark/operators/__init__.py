"""DataFrame operators: routing (F-*), processors (P-*), metrics (M-*), checks (V-*)."""
