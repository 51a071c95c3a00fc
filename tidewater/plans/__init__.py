"""End-to-end plans: feature materialisation, models, enforcement."""
