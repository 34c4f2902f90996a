"""DataFrame -> DataFrame operators (features, scaling, metrics, ranking, blending)."""
