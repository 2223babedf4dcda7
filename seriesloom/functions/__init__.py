"""seriesloom.functions"""
