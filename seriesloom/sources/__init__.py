"""seriesloom.sources"""
