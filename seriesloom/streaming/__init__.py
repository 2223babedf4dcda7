"""seriesloom.streaming"""
