"""End-to-end plans (features, blending) and the query registry."""
