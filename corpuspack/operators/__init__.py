"""DataFrame-to-DataFrame steps: selection, ordering, layout, trees."""
